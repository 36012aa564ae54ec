"""Scores and feature-selection statistics, as closed forms over grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_range(c: Column) -> Column:
    """A number that grows with the value, the same for near values: 177 ranges for each doubling. The bounds are fixed, so that
    any two looks at the data agree on them; NaN has a range above all."""
    size = F.floor(F.log1p(F.abs(c) * float(1 << 20)) * 256).cast("int")  # the logarithm never falls where the value grows
    return F.when(F.isnan(c), 1 << 30).when(c < 0, -size).otherwise(size)


def below(counts: DataFrame, value: str, by: list[str], n: str) -> DataFrame:
    """Adds _below: how many rows of the group have a smaller value, from rows (by, value, n) with each value of a group once.
    Counts are summed up in value ranges, and the ranges' sums by group, so no task holds a group."""
    ranged = counts.withColumn("_range", value_range(F.col(value)))
    before = lambda w: F.coalesce(F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = ranged.groupBy(*by, "_range").agg(F.sum(n).alias("_w"))
    starts = sums.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"), before(Window.partitionBy(*by).orderBy("_range")).alias("_start"))
    inside = ranged.withColumn("_w", F.col(n)).withColumn("_inside", before(Window.partitionBy(*by, "_range").orderBy(value)))
    same = F.col("_range").eqNullSafe(F.col("_r"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return inside.join(starts, same).withColumn("_below", F.col("_start") + F.col("_inside")).select(*counts.columns, "_below")


def mid_rank(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds rank with ties averaged. Ranks are worked out for the distinct values and joined back."""
    counts = df.groupBy(*by, value).agg(F.count("*").cast("double").alias("_n"))
    ranks = below(counts, value, by, "_n").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, value])], (F.col("_below") + (F.col("_n") + 1) / 2).alias("rank"))
    same = F.lit(True)
    for i, c in enumerate([*by, value]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ranks, same).select(*df.columns, "rank")


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """ROC-AUC by group, ties at half; 0.5 where a class is missing. Ranks come from the distinct scores' counts."""
    c = df.groupBy(*by, F.round(score, 9).alias("_s")).agg(F.sum(label).cast("double").alias("_p"), F.sum(1 - F.col(label)).cast("double").alias("_n"))
    c = below(c, "_s", by, "_n").withColumn("_u", F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    return c.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum("_u"), F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0.0))), F.lit(0.5)).alias("auc"))


def r2(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Squared Pearson correlation."""
    return df.groupBy(*by).agg(F.pow(F.corr(score, label), 2).alias("r2"))


def pearson(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.nanvl(F.corr(score, label), F.lit(0.0)), F.lit(0.0)).alias("pearson"))


def mse(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("mse"))


def f_regression(xy: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    r = F.corr(x, y)
    return xy.groupBy("variant_idx").agg((r * r / F.nullif(1 - r * r, F.lit(0.0)) * (F.count("*") - 2)).alias("score"))


def f_classif(xy: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One-way ANOVA F from class sums."""
    c = xy.groupBy("variant_idx", y).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    n, s, k = F.sum("n"), F.sum("s"), F.count("*")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n
    within = F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))
    return c.groupBy("variant_idx").agg(((between / (k - 1)) / F.nullif(within / (n - k), F.lit(0.0))).alias("score"))


def r_regression(xy: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return xy.groupBy("variant_idx").agg(F.corr(x, y).alias("score"))


def chi2(xy: DataFrame, x: str = "dosage", y: str = "y") -> DataFrame:
    """Of dosage sums by class against the class shares."""
    c = xy.groupBy("variant_idx", y).agg(F.sum(x).alias("obs"), F.count("*").alias("n"))
    w = Window.partitionBy("variant_idx")
    exp = F.col("n") / F.sum("n").over(w) * F.sum("obs").over(w)
    return c.withColumn("_e", exp).groupBy("variant_idx").agg(F.sum(F.pow(F.col("obs") - F.col("_e"), 2) / F.nullif(F.col("_e"), F.lit(0.0))).alias("score"))


def variance(xy: DataFrame, x: str = "x") -> DataFrame:
    return xy.groupBy("variant_idx").agg(F.var_pop(x).alias("score"))


def mutual_info(xy: DataFrame, x: str = "dosage", y: str = "y") -> DataFrame:
    """Plug-in mutual information of two discrete columns."""
    j = xy.groupBy("variant_idx", x, y).agg(F.count("*").alias("c"))
    v = Window.partitionBy("variant_idx")
    n, cx, cy = F.sum("c").over(v), F.sum("c").over(v.partitionBy("variant_idx", x)), F.sum("c").over(v.partitionBy("variant_idx", y))
    return j.withColumn("_t", F.col("c") / n * F.log(F.col("c") * n / (cx * cy))).groupBy("variant_idx").agg(F.sum("_t").alias("score"))


def top_k(scores: DataFrame, k: int, key: str = "variant_idx") -> DataFrame:
    return scores.where("score is not null").orderBy(F.col("score").desc(), key).limit(k)


def top_percent(scores: DataFrame, percent: float, key: str = "variant_idx") -> DataFrame:
    from .sampling import numbered, with_count

    r = numbered(with_count(scores.where("score is not null"), _n=F.count("*")).withColumn("_down", -F.col("score")), ["_down", key], "_i")
    return r.where(F.col("_i") < F.floor(F.col("_n") * percent / 100)).drop("_i", "_n", "_down")


def third_moments(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Standardised third-order moments of (x1, x2)."""
    w = Window.partitionBy(*by)
    z = [(F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)) for c in ("x1", "x2")]
    d = pairs.select(*by, z[0].alias("a"), z[1].alias("b"))
    return d.groupBy(*by).agg(F.avg(F.expr("a*a*a")).alias("m30"), F.avg(F.expr("a*a*b")).alias("m21"), F.avg(F.expr("a*b*b")).alias("m12"), F.avg(F.expr("b*b*b")).alias("m03"))
