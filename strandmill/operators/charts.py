"""The delta plot and the interaction map from end to end: from values to rows that only have to be drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import heatmap, manhattan, offsets
from .reports import centre_ticks, delta_chromosome, top_signed, within_chromosome


def delta_rows(linear: DataFrame, nonlinear: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (variant_idx, chr, pos, shap) of two models joined by chromosome and position, many-to-many matches included: delta is
    |nonlinear| - |linear|, a value that one side lacks (how: left, right, outer) counts as 0."""
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"how is inner, left, right or outer, not {how!r}")
    l = linear.select(F.col("chr").alias("_chr"), F.col("pos").alias("_pos"), F.col("variant_idx").alias("_v"), F.col("shap").alias("shap_linear"))
    n = nonlinear.select("chr", "pos", "variant_idx", F.col("shap").alias("shap_nonlinear"))
    j = l.join(n, (F.col("_chr") == F.col("chr")) & (F.col("_pos") == F.col("pos")), how)
    size = lambda c: F.coalesce(F.abs(F.col(c)), F.lit(0.0))
    return j.select(*[F.coalesce(a, b).alias(b) for a, b in (("_v", "variant_idx"), ("_chr", "chr"), ("_pos", "pos"))], "shap_linear", "shap_nonlinear", (size("shap_nonlinear") - size("shap_linear")).alias("delta"))


def delta_manhattan(linear: DataFrame, nonlinear: DataFrame, k: int, how: str = "inner") -> tuple[DataFrame, DataFrame]:
    """(rows, ticks): delta_rows with chr_norm, chr_order, x (positions added up over the chromosomes before, without gaps) and
    is_top for the k largest deltas as they are; ticks are the middle of each chromosome's rows and its commonest name."""
    label, order = delta_chromosome(F.col("chr"))
    rows = delta_rows(linear, nonlinear, how).withColumn("chr_norm", label).withColumn("chr_order", order).where("pos is not null")
    laid = rows.join(F.broadcast(offsets(rows, gap=False)), "chr_order").withColumn("x", F.col("pos") + F.col("offset")).drop("offset")  # a row for each chromosome
    best = top_signed(laid, "delta", k, "variant_idx").select(F.col("variant_idx").alias("_v"), F.col("x").alias("_x"), F.lit(True).alias("_top")).distinct()
    return laid.join(F.broadcast(best), (F.col("variant_idx") == F.col("_v")) & (F.col("x") == F.col("_x")), "left").withColumn("is_top", F.coalesce("_top", F.lit(False))).drop("_v", "_x", "_top"), centre_ticks(laid)


def interaction_map(edges: DataFrame, variants: DataFrame, bins: int) -> DataFrame:
    """(bin_i, bin_j, value) of edges (variant_i, variant_j, value) within one of the variants' chromosomes, both ends laid out
    along the genome; of a cell's edges the one with the largest (variant_i, variant_j) counts. variants: variant_idx, chr, pos."""
    laid = manhattan(variants).select("variant_idx", "chr", "x")
    ends = edges
    for e in "ij":
        ends = ends.join(laid.select(F.col("variant_idx").alias(f"variant_{e}"), F.col("chr").alias(f"chr_{e}"), F.col("x").alias(f"x_{e}")), f"variant_{e}")
    inside = within_chromosome(ends, laid.select("chr").distinct())
    return heatmap(inside.select(F.struct("variant_i", "variant_j").alias("row_id"), "x_i", "x_j", "value"), bins)
