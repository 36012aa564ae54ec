"""Genome-wide layouts: chromosome names, offsets, peaks, heat maps, cluster contrasts; all plot-ready tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chromosome(c: Column) -> Column:
    """Without a chr prefix, upper case, 23 as X and 24 as Y."""
    n = F.upper(F.regexp_replace(F.trim(c.cast("string")), "(?i)^chr", ""))
    return F.when(n == "23", "X").when(n == "24", "Y").otherwise(n)


def chromosome_order(n: Column) -> Column:
    return F.when(n == "X", 23).when(n == "Y", 24).when(n.isin("MT", "M"), 25).otherwise(n.try_cast("int"))


def offsets(v: DataFrame, gap: bool = True) -> DataFrame:
    """(chr_order, offset): cumulative largest positions of the chromosomes before, and gaps between them."""
    c = v.groupBy("chr_order").agg(F.max("pos").alias("_max"))
    w = Window.orderBy("chr_order")
    space = F.greatest(F.floor(0.005 * F.max("_max").over(Window.partitionBy())), F.lit(1_000_000)).cast("long") if gap else F.lit(0).cast("long")
    off = F.coalesce(F.sum("_max").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (F.row_number().over(w) - 1) * space
    return c.select("chr_order", off.cast("long").alias("offset"))


def manhattan(v: DataFrame, gap: bool = True) -> DataFrame:
    """Adds chr_norm, chr_order and x to rows (chr, pos, ...); unknown chromosomes and positions go."""
    n = v.withColumn("chr_norm", chromosome(F.col("chr"))).withColumn("chr_order", chromosome_order(F.col("chr_norm"))).where("chr_order is not null and pos is not null")
    return n.join(F.broadcast(offsets(n, gap)), "chr_order").withColumn("x", F.col("pos") + F.col("offset")).drop("offset")


def ticks(laid: DataFrame) -> DataFrame:
    return laid.groupBy("chr_norm").agg(F.expr("(min(x) + max(x)) div 2").alias("tick"))


def top_abs(v: DataFrame, column: str, k: int, key: str) -> DataFrame:
    return v.orderBy(F.abs(column).desc(), key).limit(k)


def islands(v: DataFrame, window: int) -> DataFrame:
    """Adds peak: runs of positions no further apart than the window, numbered by chromosome."""
    w = Window.partitionBy("chr_order").orderBy("pos", "variant_idx")
    new = F.coalesce((F.col("pos") - F.lag("pos").over(w) > window).cast("int"), F.lit(1))
    return v.withColumn("_new", new).withColumn("peak", F.sum("_new").over(w).cast("long")).drop("_new")


def running_peaks(v: DataFrame, window: int) -> DataFrame:
    """Adds peak: a row joins the first peak whose running mean position is within the window, else opens one.

    Sequential by definition, so one chromosome is one group; give it the top-k rows, as the layouts do."""

    def run(rows):
        rows = rows.sort_values(["pos", "variant_idx"])
        centres: list[list[float]] = []
        out = []
        for p in rows["pos"]:
            for i, (total, n) in enumerate(centres):
                if abs(p - total / n) <= window:
                    centres[i] = [total + p, n + 1]
                    out.append(i + 1)
                    break
            else:
                centres.append([p, 1])
                out.append(len(centres))
        return rows.assign(peak=out)

    return v.groupBy("chr_order").applyInPandas(run, v.schema.simpleString()[7:-1].replace(":", " ") + ", peak long")


def delta(linear: DataFrame, nonlinear: DataFrame) -> DataFrame:
    """|non-linear| - |linear| by chromosome and position; many-to-many matches stay."""
    l, n = linear.select("chr", "pos", F.col("shap").alias("shap_linear")), nonlinear
    return n.withColumnRenamed("shap", "shap_nonlinear").join(l, ["chr", "pos"]).withColumn("delta", F.abs("shap_nonlinear") - F.abs("shap_linear"))


def heatmap(edges: DataFrame, bins: int) -> DataFrame:
    """(bin_i, bin_j, value) with bin_i <= bin_j for rows (row_id, x_i, x_j, value); the last row of a cell wins."""
    s = edges.agg(F.least(F.min("x_i"), F.min("x_j")).alias("_lo"), F.greatest(F.max("x_i"), F.max("x_j")).alias("_hi"))
    b = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col(c) - F.col("_lo")) / F.nullif((F.col("_hi") - F.col("_lo")) / bins, F.lit(0.0))), F.lit(0)))).cast("int")
    e = edges.crossJoin(F.broadcast(s)).select("row_id", "value", b("x_i").alias("i"), b("x_j").alias("j"))  # one row
    return e.groupBy(F.least("i", "j").alias("bin_i"), F.greatest("i", "j").alias("bin_j")).agg(F.max_by("value", "row_id").alias("value"))


def cluster_range(shap: DataFrame) -> DataFrame:
    """(variant_idx, range): largest minus smallest cluster mean of rows (cluster, variant_idx, shap)."""
    return shap.where("cluster is not null").groupBy("cluster", "variant_idx").agg(F.avg("shap").alias("_m")).groupBy("variant_idx").agg((F.max("_m") - F.min("_m")).alias("range"))


def capped_labels(ranges: DataFrame, k: int, per_chr: int) -> DataFrame:
    """The k largest ranges, at most per_chr of a chromosome."""
    top = ranges.orderBy(F.col("range").desc(), "variant_idx").limit(k)
    return top.withColumn("_i", F.row_number().over(Window.partitionBy("chr").orderBy(F.col("range").desc(), "variant_idx"))).where(F.col("_i") <= per_chr).drop("_i")
