"""Shared pieces of the training-data operators: tables, the shared folder, blocks in key order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = 0xFFFFFFFFFFFFFFFF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a folder of our own on a
    local master; a cluster has to name one, since its executors don't share the driver's disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='strandmill-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """A column by its plain name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(docs: DataFrame, columns: list[str], seed: int = 0) -> Column:
    """MD5 (hex) over the columns, each with its length before it and null told from empty, so that SQL elsewhere can find
    the same order and different rows have different keys."""
    parts = []
    for c in columns:
        kind = docs.schema[c].dataType.typeName()
        shown = F.hex(quoted(c)) if kind == "binary" else F.to_json(F.struct(quoted(c).alias("x"))) if kind in ("array", "map", "struct", "variant") else quoted(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(shown).cast("string"), F.lit(":"), shown), F.lit("n")))
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *parts))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch, column: str = "text") -> list[str]:
    """The strings of a record batch's column, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lets at most so many rows cross to Python at once from now on in the session, where its setting is larger: texts and
    shingle sets are wide, and a batch is held several times on its way."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not on this system


def tidy(run):
    """A mapInArrow function that gives its memory back at the end of each task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def in_key_order(df: DataFrame, key: str, tie: Column) -> tuple[DataFrame, int]:
    """Deals rows into contiguous ranges of (key, _tie), nulls lowest: adds `_tie` (the given 64-bit hash) and `_block` (the
    range's number in order), and returns the number of ranges.

    The bounds are approximate quantiles of the key column alone (as many as shuffle partitions), so the wide columns are
    shuffled once and never sampled. A key that is a bound several times over, and null where it is common, takes as many
    ranges and is dealt over them by the tie.
    """
    n = partitions(df.sparkSession)
    found = df.agg(F.percentile_approx(F.col(key), [i / n for i in range(1, n)] or [0.5], 10000).alias("b"), F.count_if(F.col(key).isNull()).alias("nulls"), F.count("*").alias("n")).first()
    bounds = sorted(found["b"] or [])
    times = {b: bounds.count(b) for b in set(bounds)}
    hot = {b: k for b, k in times.items() if k > 1}  # as many as partitions at most
    for_nulls = n * found["nulls"] // max(found["n"], 1)
    share = F.col("_tie") / F.lit(2.0**64) + 0.5
    part = lambda k: F.least(F.floor(share * k), k - 1).cast("int")
    block = F.lit(for_nulls)
    if bounds:
        block = for_nulls + F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(key)))
    if hot:
        spread = F.try_element_at(F.create_map(*[F.lit(x).cast("long") for item in hot.items() for x in item]), F.col(key).cast("long"))
        block = block + F.coalesce(part(spread), F.lit(0))
    nulls = part(F.lit(for_nulls)) if for_nulls else F.lit(0)
    return df.withColumn("_tie", tie).withColumn("_block", F.when(F.col(key).isNull(), nulls).otherwise(block).cast("int")), len(bounds) + 1 + for_nulls


def deal(dealt: DataFrame, blocks: int, order: list) -> DataFrame:
    return dealt.repartitionById(blocks, F.col("_block")).sortWithinPartitions("_block", *order)


class Cache(dict):
    """A bounded two-generation memo: what is still in use when the young half fills up moves on, the rest goes."""

    def __init__(self, make, entries: int = 400_000):
        super().__init__()
        self.make, self.half, self.old = make, max(1, entries // 2), {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def mix64(x):
    """splitmix64's finaliser over a numpy uint64 array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Over so many tasks a key that many rows share is spread in look-ups.
SPREAD = 8


def spread_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, by: str) -> DataFrame:
    """An inner join on left_key = right_key where right has a row for each key and left may have any number: the left rows
    of a key are dealt over SPREAD tasks by the column `by`, and right is repeated for each."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int"))
    repeated = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return salted.join(repeated, (F.col(left_key) == F.col(right_key)) & (F.col("_salt") == F.col("_salt2"))).drop("_salt", "_salt2")


def components(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Connected components: (id) and (a, b) -> (id, component), component the smallest id reachable.

    Each round hooks every tree's root onto the smallest neighbouring label and then jumps pointers; labels only get
    smaller, so the rounds end by themselves when none changes. They live in tables of the shared folder, nothing but a
    count reaches the driver. Ids that no edge touches stay out of the rounds; the root of a large component and the
    centre of a star are looked up from several tasks.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), f"{name}-edges")
    labels = edges.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id"))
    changed = 1
    while changed:
        seen = labels.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
        near = spread_join(edges, seen, "b", "_i", "a").groupBy(F.col("a").alias("id")).agg(F.min("_c").alias("_m"))
        low = labels.join(near, "id").withColumn("_m", F.least("component", "_m"))
        roots = low.groupBy(F.col("component").alias("_r")).agg(F.min("_m").alias("_to"))
        hooked = spread_join(low, roots, "component", "_r", "id").select("id", F.col("component").alias("_was"), F.least("_m", "_to").alias("_m"))
        up = hooked.select(F.col("id").alias("_k"), F.col("_m").alias("_up"))
        jumped = spread_join(hooked, up, "_m", "_k", "id").select("id", "_was", F.least("_m", "_up").alias("component"))
        step = materialize(jumped, f"{name}-labels")
        changed = step.where("component <> _was").limit(1).count()
        labels = step.select("id", "component")
    return nodes.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
