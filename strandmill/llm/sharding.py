"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

Records hash into a fixed number of virtual slots; only slots have a place. The map starts even (version 0) and each
rebalancing writes an edited version: slots move from the fullest shard to the emptiest one until the bytes are near
equal. The law is `bytes`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_folder, table

SLOTS = 8192
SHARDS = 40
SUBS = 8  # parts of a slot that are numbered apart
MAP = "_s int, shard int, slot_bytes long"
SLICES = 64  # of each of a table's partitions, for numbers among equal rows


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16 for the record), text_crc32 and the hash of the group, which is the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_group"))


def in_slots(rows: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Adds `_slot` and `_sub`, a part of the slot. A group of equal texts hashes into one slot as long as one shard can
    hold it; groups over a shard's fair share, at most as many as shards, are dealt over all slots by doc_id and the row's
    number among those of its group and doc_id. That number is counted in slices of the rows, so that no task sees all
    copies."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = rows.groupBy("_group").agg(F.sum("size").alias("_b")).where(F.col("_b") > total / shards)
    large = [r[0] for r in large.select("_group").collect()]  # their bytes add up to the total at most: `shards` groups
    slot = lambda *by: F.pmod(F.xxhash64("_group", *by), F.lit(slots)).cast("int")
    sub = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(SUBS)).cast("int")
    if not large:
        return rows.withColumn("_slot", slot(F.lit(0))).withColumn("_sub", sub)
    dealt = rows.where(F.col("_group").isin(large)).withColumn("_id", F.monotonically_increasing_id()).withColumn("_slice", F.shiftrightunsigned("_id", 33) * SLICES + F.col("_id") % SLICES)
    dealt = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_group", "doc_id", "_slice").orderBy("_id")))
    dealt = dealt.withColumn("_slot", slot("doc_id", "_slice", "_row")).drop("_id", "_slice", "_row")
    return rows.where(~F.col("_group").isin(large)).withColumn("_slot", slot(F.lit(0))).unionByName(dealt).withColumn("_sub", sub)


def rebalanced(bytes_of: dict[int, int], shard_of: list[int], shards: int) -> list[int]:
    """An edited slot-to-shard map: the fewest sensible moves that bring the shards' bytes near each other.

    Shards over their fair share first give up slots, largest first, then each freed slot goes to the shard with the
    least bytes. Works on slots alone, a fixed number.
    """
    out, load = list(shard_of), [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        own[shard].append(slot)
        load[shard] += bytes_of.get(slot, 0)
    fair = sum(load) / max(1, shards)
    free = []
    for shard in range(shards):
        for slot in sorted(own[shard], key=lambda s: (-bytes_of.get(s, 0), s)):
            size = bytes_of.get(slot, 0)
            if size and load[shard] > fair:
                load[shard] -= size
                free.append(slot)
    for slot in sorted(free, key=lambda s: (-bytes_of.get(s, 0), s)):
        shard = min(range(shards), key=lambda k: (load[k], k))
        out[slot], load[shard] = shard, load[shard] + bytes_of.get(slot, 0)
    own = [[s for s in range(len(out)) if out[s] == k and bytes_of.get(s, 0)] for k in range(shards)]
    for _ in range(20 * shards):  # then the slot that narrows the widest gap most moves, as long as one does
        high, low = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        slot = min((s for s in own[high] if bytes_of[s] < gap), key=lambda s: (abs(gap - 2 * bytes_of[s]), s), default=None)
        if slot is None:
            break
        own[high].remove(slot)
        own[low].append(slot)
        out[slot] = low
        load[high] -= bytes_of[slot]
        load[low] += bytes_of[slot]
    return out


def write_map(spark: SparkSession, path: str, version: int, shard_of: list[int], sizes: dict[int, int]) -> None:
    """Stores a version of the map under path/version=N."""
    rows = [(slot, shard, sizes.get(slot, 0)) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """The shard of each slot in a stored version, the latest one by default."""
    stored = spark.read.schema(f"{MAP}, version int").parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return [r[0] for r in stored.where(F.col("version") == version).orderBy("_s").select("shard").collect()]  # a fixed number


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the row's place in its shard, from 0 without gaps), grown_shard, virtual_slot.

    Null texts count as empty; null doc_ids and repeated rows are rows like others; ties in a slot are broken by
    group, doc_id, size; an empty table gives no rows. The law `bytes` holds: shards differ by about a slot's bytes, a
    single text longer than a shard's fair share aside. Rows go where the stored map says.
    """
    spark = docs.sparkSession
    rows = materialize(in_slots(materialize(sized(docs), "sized"), shards, slots), "slots")
    counted = rows.groupBy("_slot", "_sub").agg(F.sum("size"), F.count("*")).collect()  # a fixed number of slots and parts
    sizes: dict[int, int] = {}
    for s, _, size, _ in counted:
        sizes[s] = sizes.get(s, 0) + size
    counts = {(r[0], r[1]): r[3] for r in counted}
    path = path or new_folder(spark, "slot-map")
    write_map(spark, path, 0, [s % shards for s in range(slots)], sizes)
    write_map(spark, path, 1, rebalanced(sizes, read_map(spark, path, 0), shards), sizes)
    final = read_map(spark, path)
    first, seen = [], [0] * shards
    for s in range(slots):
        for k in range(SUBS):
            if n := counts.get((s, k), 0):
                first.append((s, k, final[s], seen[final[s]]))
                seen[final[s]] += n
    places = spark.createDataFrame(first, "_s int, _k int, shard int, _first long")
    within = Window.partitionBy("_slot", "_sub").orderBy("_group", "doc_id", "size")
    placed = rows.withColumn("_n", F.row_number().over(within) - 1).join(F.broadcast(places), (F.col("_slot") == F.col("_s")) & (F.col("_sub") == F.col("_k")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_first") + F.col("_n")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("_slot").alias("virtual_slot"),
    )


def grow(shard_of: list[int], bytes_of: dict[int, int], shards: int) -> list[int]:
    """The next version for one more shard: slots move only into it, taken in turn from the fullest shards."""
    out, load = list(shard_of), [0] * (shards + 1)
    own: list[list[int]] = [[] for _ in range(shards)]
    for slot, s in enumerate(out):
        own[s].append(slot)
        load[s] += bytes_of.get(slot, 0)
    fair = sum(load) / (shards + 1)
    for s in own:
        s.sort(key=lambda x: (bytes_of.get(x, 0), x))
    while load[shards] < fair:
        fullest = max(range(shards), key=lambda k: (load[k], -k))
        if not own[fullest] or not load[fullest]:
            break
        slot = own[fullest].pop()
        size = bytes_of.get(slot, 0)
        if load[shards] + size > fair and load[shards] > 0:
            break
        out[slot] = shards
        load[fullest] -= size
        load[shards] += size
    return out


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
