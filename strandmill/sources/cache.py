"""Kept tables: preloaded calls, datasets and statistics by content, paths from the environment, run metrics."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators.reports import content_hash

PATHS = {"fam": "FAM_PATH", "bed": "BED_PATH", "bim": "BIM_PATH", "master": "MASTER_PATH"}


def preload(calls: DataFrame) -> DataFrame:
    """Keeps calls in executors' memory, and on their disks beyond it."""
    return calls.persist(StorageLevel.MEMORY_AND_DISK)


def paths(options: dict[str, str] | None = None) -> dict[str, str]:
    """The four inputs' paths, from options or else the environment. A bytes literal taken for text is an error."""
    out = {}
    for name, variable in PATHS.items():
        value = (options or {}).get(name) or os.environ.get(variable)
        if not value:
            raise ValueError(f"no path for {name}: give it or set {variable}")
        if value.startswith(("b'", 'b"')):
            raise ValueError(f"{value} is a bytes literal, not a path")
        out[name] = value
    return out


def key_of(settings: dict, *contents: DataFrame) -> str:
    """A name for what is computed from settings and the contents of tables (whole rows, in any order)."""
    seen = [content_hash(x, x.columns).first() for x in contents]  # a row for each table
    return hashlib.md5(json.dumps([settings, [(r["n"], r["hash"]) for r in seen]], sort_keys=True).encode()).hexdigest()


def kept(spark: SparkSession, folder: str, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table folder/name-key; made and written where it isn't there yet. A table that was cut short is made anew."""
    path = f"{folder.rstrip('/')}/{name}-{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def files_of(df: DataFrame) -> list[tuple[str, int, int]]:
    """Path, length and time of the files that a frame reads; none where it reads no files."""
    jvm, conf, out = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration(), []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return out


def statistics(spark: SparkSession, folder: str, calls: DataFrame, samples: DataFrame, make: Callable[[DataFrame], DataFrame], settings: dict | None = None) -> DataFrame:
    """Variant statistics of some samples (sample_idx), kept by the ids, the settings and the files that the calls come from
    (their lengths and times, so a hit reads no call); calls that come from no files are hashed themselves. Calls that are
    made from their files in different ways need different settings."""
    ids = samples.select("sample_idx").distinct()
    own = calls.join(ids, "sample_idx", "left_semi")
    files = files_of(calls)
    key = key_of({"columns": calls.columns, "files": files, **(settings or {})}, ids, *([] if files else [own]))
    return kept(spark, folder, "variant-stats", key, lambda: make(own))


def blocks(spark: SparkSession, folder: str, samples: DataFrame, variants: DataFrame, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """Linkage blocks, kept by samples, variants and all settings."""
    return kept(spark, folder, "ld-blocks", key_of(settings, samples.select("sample_idx"), variants.select("variant_idx")), make)


def plot_inputs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that sinks wrote for the layouts: annotations, interactions, local values, those that are there."""
    out = {}
    for name in ("annotations", "interactions", "local"):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            out[name] = spark.read.parquet(str(hadoop.toString()))
    return out


def metrics(scores: DataFrame, run: str, per_batch: int) -> DataFrame:
    """(run, batch, n_estimators, best, mean): the running record of training from (estimator_idx, score)."""
    from pyspark.sql import functions as F

    b = F.floor(F.col("estimator_idx") / per_batch).cast("int")
    return scores.groupBy(b.alias("batch")).agg(F.count("*").alias("n_estimators"), F.max("score").alias("best"), F.avg("score").alias("mean")).select(F.lit(run).alias("run"), "batch", "n_estimators", "best", "mean")
