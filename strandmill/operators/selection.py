"""Choosing rows: checked ids, slices by position or label, index-list splits, draws that hold both classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.views import md5_order
from .sampling import bottom_k, numbered

ATTEMPTS = 10


def missing_ids(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The asked ids that rows lacks."""
    return asked.select(key).distinct().join(rows.select(key), key, "left_anti")


def shared_keys(left: DataFrame, right: DataFrame, as_text: DataFrame, key: str) -> DataFrame:
    """(key, matched_as): the left keys that right has as they are, and of the others those that as_text has once they are
    written as text."""
    same = left.join(right.select(key).distinct(), key, "left_semi")
    rest = left.join(right.select(key).distinct(), key, "left_anti")
    text = as_text.select(F.col(key).cast("string").alias("_t")).distinct()
    return same.select(key, F.lit("number").alias("matched_as")).unionByName(rest.join(text, F.col(key).cast("string") == F.col("_t"), "left_semi").select(key, F.lit("text").alias("matched_as")))


def by_label(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The rows with the asked ids; an id that isn't there is an error that names the first few."""
    if lacking := [r[0] for r in missing_ids(rows, asked, key).orderBy(key).limit(10).collect()]:
        raise ValueError(f"no rows with {key} {lacking}")
    return rows.join(asked.select(key).distinct(), key, "left_semi")


def by_position(rows: DataFrame, key: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """A slice of the rows in order of a unique key: places are counted, ids are not looked at."""
    if step < 1 or start < 0 or (stop is not None and stop < 0):
        raise ValueError("a slice goes forward from a place that isn't negative")
    at = F.col("_at")
    got = numbered(rows, [key], "_at").where((at >= start) & ((at - start) % step == 0))
    return (got if stop is None else got.where(at < stop)).drop("_at")


def split_by_lists(rows: DataFrame, lists: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """One frame for each list of ids, the first one the training rows; no id may be in two lists or missing from rows."""
    tagged = None
    for name, ids in lists.items():
        one = ids.select(key).distinct().withColumn("_list", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    if tagged.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("an id is in two lists")
    return {name: by_label(rows, ids, key) for name, ids in lists.items()}


def label_scale(rows: DataFrame, label: str, train: str = "split = 'train'") -> DataFrame:
    """(mean, sd) of the training labels, sd 1 where they are all equal."""
    got = rows.where(train).agg(F.avg(label).alias("mean"), F.stddev_pop(label).alias("sd"))
    return got.select("mean", F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0)).alias("sd"))


def standardised_label(rows: DataFrame, label: str, scale: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(scale)).withColumn(label, (F.col(label) - F.col("mean")) / F.col("sd")).drop("mean", "sd")  # one row


def restored_label(rows: DataFrame, column: str, scale: DataFrame) -> DataFrame:
    """The inverse, for predictions."""
    return rows.crossJoin(F.broadcast(scale)).withColumn(column, F.col(column) * F.col("sd") + F.col("mean")).drop("mean", "sd")  # one row


def draw_seed(estimator: Column, seed: int, fixed: bool) -> Column:
    """The seed of an estimator's sample draw: its own, or one for all estimators."""
    return F.lit(seed) if fixed else estimator + F.lit(seed)


def sample_draws(rows: DataFrame, estimators: int, size: int, seed: int, fixed: bool) -> DataFrame:
    """(estimator_idx, sample_idx): uniform draws of each estimator, or one draw for all of them."""
    e = rows.sparkSession.range(estimators).select(F.col("id").cast("int").alias("estimator_idx"))
    if fixed:
        return rows.select("sample_idx").orderBy(md5_order(seed, "sample_idx"), "sample_idx").limit(size).crossJoin(F.broadcast(e)).select("estimator_idx", "sample_idx")
    key = F.md5(F.concat_ws("_", F.col("sample_idx").cast("string"), draw_seed(F.col("estimator_idx"), seed, False).cast("string")))
    return bottom_k(rows.select("sample_idx").crossJoin(F.broadcast(e)), key, "sample_idx", F.lit(size), ["estimator_idx"]).select("estimator_idx", "sample_idx")


def draw_with_classes(rows: DataFrame, label: str, size: int, seed: int, attempts: int = ATTEMPTS) -> DataFrame:
    """A uniform draw that holds all classes of the rows: seed, seed + 1, ... until one does; an error after `attempts`."""
    classes = rows.where(F.col(label).isNotNull()).agg(F.countDistinct(label)).first()[0]
    for k in range(attempts):
        got = rows.orderBy(md5_order(seed + k, "sample_idx"), "sample_idx").limit(size)
        if got.where(F.col(label).isNotNull()).agg(F.countDistinct(label)).first()[0] == classes:
            return got.withColumn("attempt", F.lit(k))
    raise ValueError(f"no draw of {size} rows in {attempts} holds all classes")


def simulation_split(rows: DataFrame, p: float, seed: int) -> DataFrame:
    """Adds split: a share p for the test, then p / (1 - p) of the rest for validation, by hash cut points."""
    u = lambda tag: F.conv(F.substring(md5_order(f"{tag}{seed}", "sample_idx"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(u("t") < p, "test").when(u("v") < p / (1 - p), "val").otherwise("train"))


def balanced_draw(rows: DataFrame, label: str, k: int, seed: int, size: int | None = None) -> DataFrame:
    """All cases and k controls for each, at most `size` rows together where that is given (controls go first)."""
    counted = rows.crossJoin(F.broadcast(rows.agg(F.count_if(F.col(label) == 1).alias("_c"))))  # one row
    controls = k * F.col("_c") if size is None else F.least(k * F.col("_c"), F.greatest(F.lit(0), F.lit(size) - F.col("_c")))
    most = F.when(F.col(label) == 1, F.col("_c")).otherwise(controls)
    return bottom_k(counted, md5_order(seed, "sample_idx"), "sample_idx", most, [label]).drop("_c")
