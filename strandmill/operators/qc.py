"""Variant quality control, filters, labels and standardisation. Statistics come from one aggregate over the calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def variant_stats(calls: DataFrame, *more) -> DataFrame:
    """MAF, missingness and A0 frequency of each variant in one pass: (variant_idx, maf, missingness, a0_freq), and what more
    aggregates are asked for."""
    x, p = F.col("dosage"), F.avg("dosage") / 2
    a0 = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.coalesce(F.sum(x), F.lit(0)) / F.greatest(F.count(x), F.lit(1)) / 2))
    return calls.groupBy("variant_idx").agg(F.least(p, 1 - p).alias("maf"), F.avg(x.isNull().cast("double")).alias("missingness"), a0.alias("a0_freq"), *more)


def filter_variants(stats: DataFrame, maf: float = 0.0, missingness: float = 0.05) -> DataFrame:
    """0 and 1 turn a filter off; a null MAF fails an active one."""
    out = stats.where(F.col("maf") >= maf) if maf > 0 else stats
    return out.where(F.col("missingness") <= missingness) if missingness < 1 else out


def standardize(calls: DataFrame, stats: DataFrame, more: tuple = ()) -> DataFrame:
    """(sample_idx, variant_idx, x) and what more is asked for: centred on A0, scaled by sqrt(2 maf (1 - maf)); missing calls and null MAFs are 0."""
    sd = F.sqrt(2 * F.col("maf") * (1 - F.col("maf")))
    x = (F.col("dosage") - 2 * F.col("a0_freq")) / F.when(sd == 0, 1.0).otherwise(sd)
    return calls.join(stats.select("variant_idx", "maf", "a0_freq"), "variant_idx").select("sample_idx", "variant_idx", F.coalesce(x, F.lit(0.0)).alias("x"), *more)


def prepare_samples(fam: DataFrame, master: DataFrame, label: str, populations: list[str], sex: str | None = None) -> DataFrame:
    """Joined samples in .fam order: population and sex filters, the first row of each id, sentinels as null, labels not null.

    fam: sample_idx, iid; master: IID, _row, population, sex and more; both keep every column of their own."""
    m = master.where(F.col("population").isin(sorted(populations)))
    if sex:
        m = m.where(F.col("sex") == {"m": 1, "w": 0}[sex])
    m = m.withColumn("_n", F.row_number().over(Window.partitionBy("IID").orderBy("_row"))).where("_n = 1").drop("_n", "_row")
    m = m.select(*[F.when(F.col(c).cast("string").isin("-9", "-9.0"), None).otherwise(F.col(c)).alias(c) for c in m.columns])
    m = m.where(F.col("IID").isNotNull() & F.col(label).isNotNull())
    m = m.withColumnRenamed("IID", "_master_iid")
    return fam.join(m, F.col("iid") == F.col("_master_iid")).drop("_master_iid")


def recode_binary(rows: DataFrame, label: str, compat: bool = False) -> DataFrame:
    """Two labels other than {0, 1} become 0 and 1: above the lower one, or with compat above the median."""
    s = rows.agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.percentile(label, F.lit(0.5)).alias("_mid"), F.count_distinct(label).alias("_k"))
    j = rows.crossJoin(F.broadcast(s))  # one row
    recode = (F.col("_k") == 2) & ~((F.col("_lo") == 0) & (F.col("_hi") == 1))
    return j.withColumn(label, F.when(recode, (F.col(label) > F.col("_mid" if compat else "_lo")).cast("double")).otherwise(F.col(label).cast("double"))).drop("_lo", "_hi", "_mid", "_k")


def zscore(rows: DataFrame, column: str, by: list[str] | None = None, fit: str | None = None) -> DataFrame:
    """Adds z of a column by group; with `fit` (a condition) mean and deviation come from those rows alone."""
    c = F.when(F.expr(fit), F.col(column)) if fit else F.col(column)
    s = rows.groupBy(*(by or [])).agg(F.avg(c).alias("_m"), F.stddev_pop(c).alias("_s"))
    j = rows.join(s, by) if by else rows.crossJoin(F.broadcast(s))
    return j.withColumn("z", (F.col(column) - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")


def without_outliers(rows: DataFrame, column: str, threshold: float) -> DataFrame:
    return zscore(rows, column).where(F.abs("z") < threshold).drop("z") if threshold > 0 else rows


def class_weights(rows: DataFrame, label: str, halved: bool) -> DataFrame:
    """n / n_c, or n / (2 n_c) when there are exactly two classes (else null)."""
    c = rows.groupBy(label).agg(F.count("*").alias("n_class"))
    t = c.agg(F.sum("n_class").alias("_n"), F.count("*").alias("_k"))
    w = F.col("_n") / F.col("n_class")
    return c.crossJoin(F.broadcast(t)).select(label, "n_class", (F.when(F.col("_k") == 2, w / 2) if halved else w).alias("weight"))


def case_ratio(rows: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """(n, cases, ratio) of labels 0 and 1, by group where one is asked for."""
    y = F.col(label)
    return rows.where(y.isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("cases"), F.avg(y.cast("double")).alias("ratio"))


def maf_drift(before: DataFrame, after: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(max_diff, drifted): the largest difference between two tables' MAF (variant_idx, maf), and how many exceed the tolerance."""
    j = before.join(after.select("variant_idx", F.col("maf").alias("_m")), "variant_idx").select(F.abs(F.col("maf") - F.col("_m")).alias("_e"))
    return j.agg(F.max("_e").alias("max_diff"), F.count_if(F.col("_e") > tolerance).alias("drifted"))
