"""Tables that leave the engine: annotations, local values, ordered rows, errors, names, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import chromosome, chromosome_order


def only_estimator(preds: DataFrame) -> DataFrame:
    """The predictions of the one estimator there is; more or none is an error."""
    n = preds.select("estimator_idx").distinct().count()
    if n != 1:
        raise ValueError(f"{n} estimators where one is needed")
    return preds.drop("estimator_idx")


def first_annotation(notes: DataFrame, columns: list[str], key: str = "variant_idx") -> DataFrame:
    """The first value that isn't null of each column, in estimator order."""
    return notes.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("estimator_idx"))).alias(c) for c in columns])


def values_by_type(values: DataFrame, estimators: DataFrame, column: str) -> DataFrame:
    """(variant_idx, model_type, value, value_abs): sums over estimators, divided by the number of estimators of the type, so
    that an estimator without the variant counts as zero. estimators: (estimator_idx, model_type)."""
    n = estimators.groupBy("model_type").agg(F.count("*").alias("_n"))
    of = values.join(F.broadcast(estimators), "estimator_idx").groupBy("variant_idx", "model_type").agg(F.sum(column).alias("_s"), F.sum(F.abs(column)).alias("_a"))  # a row for each estimator
    return of.join(F.broadcast(n), "model_type").select("variant_idx", "model_type", (F.col("_s") / F.col("_n")).alias("value"), (F.col("_a") / F.col("_n")).alias("value_abs"))


def local_values(values: DataFrame, estimators: int) -> DataFrame:
    """(sample_idx, variant_idx, phi): the mean over all estimators, an absent value counting as zero."""
    return values.groupBy("sample_idx", "variant_idx").agg((F.sum("phi") / F.lit(float(estimators))).alias("phi"))


def with_iid(values: DataFrame, samples: DataFrame) -> DataFrame:
    """Adds the samples' iid."""
    return values.join(samples.select("sample_idx", "iid"), "sample_idx", "left")


def wide_local(values: DataFrame, variants: list[int]) -> DataFrame:
    """A row for each sample, a column v<variant> for each of the given variants, absent values zero."""
    return values.groupBy("sample_idx").pivot("variant_idx", variants).agg(F.first("phi")).na.fill(0.0).select("sample_idx", *[F.col(f"`{v}`").alias(f"v{v}") for v in variants])


def multi_output(scores: DataFrame, mean: bool = True) -> DataFrame:
    """Scores (output, score) as one mean or a row for each output."""
    return scores.agg(F.avg("score").alias("score")) if mean else scores.select("output", "score")


def errors(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Mean squared errors of pred_linear and pred_tree against y by group, weighted where asked, and their difference."""
    w = F.col(weight) if weight else F.lit(1.0)
    mse = lambda c: F.sum(w * (F.col("y") - F.col(c)) ** 2) / F.nullif(F.sum(w), F.lit(0.0))
    return rows.groupBy(*by).agg(mse("pred_linear").alias("mse_linear"), mse("pred_tree").alias("mse_tree")).withColumn("delta", F.col("mse_linear") - F.col("mse_tree"))


def genomic_order(v: DataFrame) -> DataFrame:
    """Rows (chr, pos, variant_idx) in genomic order; unknown chromosomes last."""
    return v.withColumn("chr_order", chromosome_order(chromosome(F.col("chr")))).orderBy(F.col("chr_order").asc_nulls_last(), "pos", "variant_idx")


def in_order(rows: DataFrame, key: str) -> DataFrame:
    return rows.orderBy(key)


def top_signed(rows: DataFrame, column: str, k: int, key: str) -> DataFrame:
    """The k largest values as they are, not by their absolute."""
    return rows.orderBy(F.col(column).desc(), key).limit(k)


def mismatches(a: DataFrame, b: DataFrame, key: str, column: str, tolerance: float, n: int) -> DataFrame:
    """The first n keys whose values differ by more than the tolerance, or that one side lacks: a report's head."""
    j = a.select(key, F.col(column).alias("_x")).join(b.select(key, F.col(column).alias("_y")), key, "full")
    return j.where(F.col("_x").isNull() | F.col("_y").isNull() | (F.abs(F.col("_x") - F.col("_y")) > tolerance)).select(key, F.col("_x").alias("left"), F.col("_y").alias("right")).orderBy(key).limit(n)


def within_chromosome(edges: DataFrame, plotted: DataFrame) -> DataFrame:
    """Edges (chr_i, chr_j, ...) with both ends on one of the plotted chromosomes (chr)."""
    names = plotted.select(chromosome(F.col("chr")).alias("_c")).distinct()
    e = edges.withColumn("_c", chromosome(F.col("chr_i"))).where(F.col("_c") == chromosome(F.col("chr_j")))
    return e.join(F.broadcast(names), "_c", "left_semi").drop("_c")  # as many as chromosomes


def delta_chromosome(c: Column) -> tuple[Column, Column]:
    """(label, order) of the delta plot's chromosomes: X 23, Y 24, M, MT and MITO 25 as MT, leading digits a number, others 100.
    Only the prefix chr goes, so a name like chrom1 keeps its om and is unknown."""
    n = F.upper(F.trim(F.regexp_replace(c.cast("string"), "^(?i:chr|chrom)", "")))
    digits = F.regexp_extract(n, r"^(\d+)", 1).try_cast("int")
    order = F.when(n == "X", 23).when(n == "Y", 24).when(n.isin("M", "MT", "MITO"), 25).otherwise(F.coalesce(digits, F.lit(100)))
    label = F.when(n.isin("X", "Y"), n).when(n.isin("M", "MT", "MITO"), "MT").otherwise(F.coalesce(digits.cast("string"), n))
    return label, order.cast("int")


def reduction_chromosome(c: Column) -> Column:
    """As layout.chromosome, with M, MT and MITO as MT."""
    n = chromosome(c)
    return F.when(n.isin("M", "MT", "MITO"), "MT").otherwise(n)


def peak_labels(rows: DataFrame, window_peaks: DataFrame, most: int = 3) -> DataFrame:
    """(chr_order, peak, label): at most `most` names of a peak by largest value, joined by commas, and how many more there are."""
    r = window_peaks.withColumn("_i", F.row_number().over(Window.partitionBy("chr_order", "peak").orderBy(F.abs("shap").desc(), "variant_idx")))
    few = r.where(F.col("_i") <= most).groupBy("chr_order", "peak").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "snp"))), lambda x: x["snp"]), ",").alias("label"))
    return few.join(r.groupBy("chr_order", "peak").agg((F.greatest(F.count("*") - most, F.lit(0))).alias("more")), ["chr_order", "peak"])


def centre_ticks(laid: DataFrame) -> DataFrame:
    """(chr_order, tick, label): the median position and the commonest name of each chromosome, the first of equals."""
    names = laid.groupBy("chr_order", "chr_norm").agg(F.count("*").alias("_n")).groupBy("chr_order").agg(F.min_by("chr_norm", F.struct((-F.col("_n")).alias("n"), F.col("chr_norm").alias("c"))).alias("label"))
    return laid.groupBy("chr_order").agg(F.percentile("x", F.lit(0.5)).alias("tick")).join(names, "chr_order")


def file_name(*parts: Column, kind: str = "parquet") -> Column:
    """Parts in lower case joined by underscores, other characters than letters and digits as one underscore each run."""
    return F.concat(F.regexp_replace(F.lower(F.concat_ws("_", *parts)), "[^a-z0-9]+", "_"), F.lit(f".{kind}"))


def truth(text: Column) -> Column:
    """A setting's text as a boolean: false, 0 and no are false, all else is true; null stays null."""
    return ~F.lower(F.trim(text)).isin("false", "0", "no")


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the rows' number and an order-free hash of the columns, the sum of 60-bit MD5s, null told from empty."""
    one = F.concat_ws("#", *[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("n")) for c in columns])
    h = F.conv(F.substring(F.md5(one), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.md5(F.coalesce(F.sum(h), F.lit(0)).cast("string")).alias("hash"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def mean_by_type(preds: DataFrame) -> DataFrame:
    """(sample_idx, model_name, pred): the plain mean over the estimators of a model's name."""
    return preds.groupBy("sample_idx", "model_name").agg(F.avg("pred").alias("pred"))


def components_diagnostics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: var_<c> of each column, corr_<a>_<b> of each pair of columns."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    return rows.agg(*[F.var_pop(c).alias(f"var_{c}") for c in columns], *[F.corr(a, b).alias(f"corr_{a}_{b}") for a, b in pairs])
