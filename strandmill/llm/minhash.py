"""MinHash near-dedup with DartMinHash signatures.

A document is the set of its five-word shingles. Darts are thrown into the plane of weight and rank: each element
(shingle) owns a strip as wide as its weight, cut into regions by powers of two; a region's darts (a Poisson number,
their ranks, weights and coordinates) follow from hashes of element and region alone. Regions are visited in order of
rank until every coordinate has a dart; the earliest dart of each coordinate is the signature, whose agreement has the
expectation of the weighted Jaccard similarity. The work is about elements + k log k instead of elements * k.

Signatures are banded. Equal word sequences are one class beforehand. In a bucket each member is compared exactly with
the bucket's centre (its smallest member), which takes a pair for each member, not for each two. What then still lies in
different components within one bucket meets in blocks, where parity sketches rule out without error what can't reach
the threshold, and the rest is compared exactly; so no bucket is cut and no link between components is lost to the star.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, mix64, partitions, quoted, row_key, small_batches, spread_join, table, tidy
from .wordcoder import parts_of

WORDS = 5
THRESHOLD = 0.8
ROWS = 6
BANDS = 32
SKETCH = 4096
#: Members of a bucket meet in blocks of about so many.
BLOCK = 256
#: Tasks over which equal texts are spread when they are looked up.
SALTS = 16
PART_BYTES = 4_000_000  # of text are shingled at once
_G = np.uint64(0x9E3779B97F4A7C15)
_BASE = -10  # the first region of rank is [0, 2**_BASE), the next ones double


def _poisson_cdf(mean: float) -> np.ndarray:
    most = int(mean + 12 * mean**0.5 + 12)
    steps = np.log(mean) - np.log(np.arange(1, most + 1))
    return np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(steps)]) - mean))


class DartMinHash:
    """signature(elements, weights): k 64-bit values, one for each coordinate; equal weighted sets have equal ones."""

    def __init__(self, k: int, seed: int = 1):
        self.k, self.seed = k, np.uint64(seed * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)
        self.cdf: dict[float, np.ndarray] = {}

    def _region(self, x, w, layer: int, slabs: range):
        """Darts of the elements in a layer of weight and some slabs of rank: (rank, coordinate, value)."""
        w0, w1 = (0.0, 1.0) if layer == 0 else (2.0 ** (layer - 1), 2.0**layer)
        low = np.array([0.0 if s == 0 else 2.0 ** (_BASE + s - 1) for s in slabs])
        wide = np.array([2.0 ** (_BASE + max(s - 1, 0)) for s in slabs])
        salt = np.array([(layer * 1009 + s) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF for s in slabs], dtype=np.uint64) ^ self.seed
        own = mix64((x * _G)[None, :] + salt[:, None])
        u = (own >> np.uint64(11)) * 2.0**-53
        n = np.empty(own.shape, dtype=np.int64)
        for i, r in enumerate(wide.tolist()):
            mean = self.k * (w1 - w0) * r
            if mean not in self.cdf:
                self.cdf[mean] = _poisson_cdf(mean)
            n[i] = np.searchsorted(self.cdf[mean], u[i], side="right")
        n = n.ravel()
        who = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix64(own.ravel()[who] + (nth.astype(np.uint64) + np.uint64(1)) * _G)
        slab = who // len(x)
        rank = low[slab] + wide[slab] * ((mix64(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(11)) * 2.0**-53)
        j = (dart % np.uint64(self.k)).astype(np.int64)
        if layer or w.min() < 1:
            weight = w0 + (w1 - w0) * ((mix64(dart + np.uint64(0x1234567)) >> np.uint64(11)) * 2.0**-53)
            hit = weight <= w[who - slab * len(x)]
            rank, j, dart = rank[hit], j[hit], dart[hit]
        return rank, j, dart

    def signature(self, x: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        w = np.ones(len(x)) if w is None else np.asarray(w, float)
        x, w = x[w > 0], w[w > 0]
        out = np.zeros(self.k, dtype=np.uint64)
        if not len(x):
            return out
        layers = 1 + max(0, int(np.ceil(np.log2(w.max()))))
        filled = np.zeros(self.k, dtype=bool)
        # the slabs that very likely fill all coordinates come at once, more follow one by one
        first, after = 0, 1 + max(0, int(np.ceil(np.log2((np.log(self.k) + 1.0) / w.sum()) - _BASE)))
        with np.errstate(over="ignore"):
            while True:
                got = []
                for layer in range(layers):
                    on = slice(None) if layer == 0 else w > 2.0 ** (layer - 1)
                    if len(x[on]):
                        got.append(self._region(x[on], w[on], layer, range(first, after)))
                rank, j, value = (np.concatenate(c) for c in zip(*got)) if len(got) > 1 else got[0]
                late_first = np.argsort(-rank, kind="stable")
                j, value = j[late_first], value[late_first]
                new = ~filled[j]
                out[j[new]] = value[new]  # the earliest of a coordinate is assigned last
                filled[j] = True
                if filled.all():
                    return out
                first, after = after, after + 1


def odd_sketch(shingles: np.ndarray) -> bytes:
    """SKETCH parity bits. Two sketches differ in no more bits than the sets have elements in only one of them, so sets
    whose sketches differ in over (|A| + |B|) (1 - t) / (1 + t) bits are surely less than t alike."""
    bit = np.bincount((mix64(shingles + _G) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(bit.astype(np.uint8)).tobytes()


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 63-bit key for each band."""
    s = signature.reshape(-1, rows)
    key = np.arange(1, len(s) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mix64(key * _G + s[:, i])
    return (key >> np.uint64(1)).astype(np.int64)


def words_in(texts):
    """The lower-cased white-space words of each text of an Arrow column, as lists; a text without any has one empty word."""
    import pyarrow.compute as pc

    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts.fill_null(""))))


class Shingler:
    def __init__(self, words: int = WORDS):
        self.words = words

    def column(self, lists) -> list[np.ndarray]:
        """The sorted distinct shingles of each list of words, as hashes; a shorter list is one shingle, without words none."""
        import pandas as pd

        k = self.words
        coded = lists.flatten().dictionary_encode()
        own = pd.util.hash_array(np.array([*coded.dictionary.to_pylist(), ""], dtype=object), categorize=False)
        nothing = own[-1]
        h = own[coded.indices.to_numpy(zero_copy_only=False)]
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64).tolist()
        at = np.full(max(0, len(h) - k + 1), k, dtype=np.uint64)
        out = []
        with np.errstate(over="ignore"):
            for i in range(k):
                at = mix64(at * _G + h[i : i + len(at)])
            for a, b in zip([0, *ends], ends):
                if b - a >= k:
                    out.append(np.unique(at[a : b - k + 1]))
                elif b - a == 1 and h[a] == nothing:
                    out.append(np.zeros(0, dtype=np.uint64))
                else:
                    s = np.full(1, b - a, dtype=np.uint64)
                    for x in h[a:b]:
                        s = mix64(s * _G + x)
                    out.append(s)
        return out

    def __call__(self, text: str) -> np.ndarray:
        import pyarrow as pa

        return self.column(words_in(pa.array([text], pa.string())))[0]


def content_keys(lists) -> list[bytes]:
    """128 bits of each list of words."""
    import pyarrow.compute as pc

    return [hashlib.blake2b(x, digest_size=16).digest() for x in pc.binary_join(lists, " ").cast("binary").to_pylist()]


def classes(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns and `_key`, 128 bits of the lower-cased words: rows with one key are copies."""

    @F.pandas_udf("binary")
    def key(text):
        import pandas as pd
        import pyarrow as pa

        texts, out = pa.array(text, pa.string(), from_pandas=True), []
        for a, b in parts_of(texts, PART_BYTES):
            out += content_keys(words_in(texts.slice(a, b - a)))
        return pd.Series(out, dtype=object)

    return docs.select(*columns, key(F.col("text")).alias("_key"))


def _signed(docs: DataFrame, words: int, n_bands: int, rows: int) -> DataFrame:
    """(doc_id, _key, _raw, size, sketch, bands) of every row; the last three for the first of each class in a task.
    _raw is the text's own hash, by which texts are found again."""

    def run(batches):
        import pyarrow as pa

        shingle, darts = Shingler(words), DartMinHash(n_bands * rows)
        seen: set[bytes] = set()
        for batch in batches:
            texts = batch.column(2)
            for a, b in parts_of(texts, PART_BYTES):
                lists = words_in(texts.slice(a, b - a))
                keys = content_keys(lists)
                new = np.array([i for i, k in enumerate(keys) if k not in seen and not seen.add(k)], dtype=np.int64)
                if len(seen) > 1_000_000:
                    seen.clear()
                sets: list = [()] * len(keys)
                for i, x in zip(new.tolist(), shingle.column(lists.take(pa.array(new)))):
                    sets[i] = x
                sketch = [odd_sketch(x) if len(x) else None for x in sets]
                own = [bands(darts.signature(x), rows) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.binary()), batch.column(1).slice(a, b - a), pa.array([len(x) for x in sets], pa.int32()), pa.array(sketch, pa.binary()), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "_key", "_raw", "size", "sketch", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_raw"), "text").mapInArrow(tidy(run), "doc_id long, _key binary, _raw long, size int, sketch binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(k, s): the shingles of the classes in `wanted` (_key, _raw). Texts are found by their hash, in one shuffle whatever
    the number of wanted ones; only those found are read into shingles."""

    def run(batches):
        import pyarrow as pa

        shingle, seen = Shingler(words), set()
        for batch in batches:
            for a, b in parts_of(batch.column(0), PART_BYTES):
                lists = words_in(batch.column(0).slice(a, b - a))
                keys = content_keys(lists)
                new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
                if len(seen) > 1_000_000:
                    seen.clear()
                sets = shingle.column(lists.take(pa.array(new, pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in new], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["k", "s"])

    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))  # copies of one text, however many, meet in as many tasks
    hashes = wanted.select(F.col("_raw").alias("_h")).distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    texts = docs.select("text", F.xxhash64("text").alias("_h"), salt.alias("_salt")).join(hashes.hint("merge"), ["_h", "_salt"], "left_semi")
    found = texts.select("text").mapInArrow(tidy(run), "k binary, s binary").join(wanted.select(F.col("_key").alias("k")), "k", "left_semi")
    return materialize(found.groupBy("k").agg(F.first("s").alias("s")), "shingle-sets")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, name: str) -> DataFrame:
    """The pairs (a, b) of class keys whose shingle sets are at least `threshold` alike, exactly."""

    @F.pandas_udf("boolean")
    def alike(x, y):
        import pandas as pd

        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = 0 if min(len(p), len(q)) < threshold * max(len(p), len(q)) else len(np.intersect1d(p, q, assume_unique=True))
            out.append(both >= threshold * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("_sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("_sb")), "b")
    return materialize(both.where(alike("_sa", "_sb")).select("a", "b"), f"{name}-links")


def _across(members: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) in different components of one bucket: rows (band, _key, component, size, sketch).

    A bucket of m members is dealt into m / BLOCK blocks by hash and each two blocks meet in a group of their own, where
    sketches rule out, without error, what can't reach the threshold; only what is left becomes a row."""
    spare = (1 - threshold) / (1 + threshold)
    sized = members.groupBy("band").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("_n"))
    m = spread_join(members, sized.withColumnRenamed("band", "_band"), "band", "_band", "_key").withColumn("_b", F.pmod(F.xxhash64("_key", "band"), F.col("_n")).cast("int"))
    m = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    m = m.select("band", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "_key", "component", "size", "sketch")

    def run(batches):
        import pyarrow as pa

        group, held = None, []

        def meet():
            if len(held) < 2:
                return [], []
            comps = {c: i for i, c in enumerate({r[2] for r in held})}
            keys = [r[1] for r in held]
            block, comp, size = np.array([r[0] for r in held]), np.array([comps[r[2]] for r in held]), np.array([r[3] for r in held])
            bits = np.frombuffer(b"".join(r[4] for r in held), dtype=np.uint64).reshape(len(held), -1)
            left, right = (np.arange(len(held)),) * 2 if group[1] == group[2] else (np.nonzero(block == group[1])[0], np.nonzero(block == group[2])[0])
            a, b = [], []
            for i in left:
                js = right[right > i] if group[1] == group[2] else right
                js = js[(comp[js] != comp[i])]
                js = js[np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64) <= spare * (size[js] + size[i]) + 1e-9]
                for j in js.tolist():
                    x, y = sorted((keys[i], keys[j]))
                    a.append(x)
                    b.append(y)
            return a, b

        for batch in batches:
            out_a, out_b = [], []
            for band, i, j, own, key, component, size, sketch in zip(*[batch.column(c).to_pylist() for c in range(8)]):
                if (band, i, j) != group:
                    a, b = meet()
                    out_a += a
                    out_b += b
                    group, held = (band, i, j), []
                held.append((own, key, component, size, sketch))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])
        a, b = meet()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    n = partitions(members.sparkSession)
    return m.repartition(n, "band", "_i", "_j").sortWithinPartitions("band", "_i", "_j").mapInArrow(tidy(run), "a binary, b binary").distinct()


def near_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, n_bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _key) of every row and (id, component) of every class that has links, both by class key.

    Null texts count as empty; all texts without words are one class; ties, repeated rows and null doc_ids fall into
    the classes of their texts; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    signed = materialize(_signed(docs, words, n_bands, rows), "signed")
    classes_ = signed.where("bands is not null").groupBy("_key").agg(F.min("_raw").alias("_raw"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    classes_ = materialize(classes_, "near-classes")
    buckets = classes_.select("_key", F.explode(F.array_distinct("bands")).alias("band"))
    centres = buckets.groupBy("band").agg(F.min("_key").alias("_c"), F.max("_key").alias("_z")).where("_c <> _z").select(F.col("band").alias("_band"), "_c")
    shared = materialize(spread_join(buckets, centres, "band", "_band", "_key").select("_key", "band", "_c"), "buckets")
    wanted = materialize(classes_.select("_key", "_raw", "size", "sketch").join(shared.select("_key").distinct(), "_key", "left_semi"), "wanted")
    sets = _sets(docs, wanted, words)
    star = shared.where("_key <> _c").select(F.col("_c").alias("a"), F.col("_key").alias("b")).distinct()
    links = _verified(star, sets, threshold, "star")
    nodes = wanted.select(F.col("_key").alias("id"))
    found = materialize(components(nodes, links, "star"), "star-components")
    placed = shared.join(found.select(F.col("id").alias("_key"), "component"), "_key").select("band", "_key", "component")
    mixed = placed.groupBy("band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("band")
    rest = placed.join(mixed, "band", "left_semi").join(wanted.select("_key", "size", "sketch"), "_key")
    more = materialize(_across(rest, threshold), "rest")
    more_links = _verified(more, sets, threshold, "rest")
    if more_links.limit(1).count():
        found = materialize(components(nodes, links.unionByName(more_links), "near"), "near-components")
    return signed.select("doc_id", "_key"), found


def near_dedup(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, group_id (the smallest doc_id of the group), group_size and kept of every row; a group is the rows that
    links of likeness >= 0.8 or equal words connect. Of repeated rows with the group's smallest doc_id each is kept."""
    rows, found = near_classes(docs, **settings)
    sums = rows.groupBy("_key").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n"))
    of = sums.join(found.withColumnRenamed("id", "_key"), "_key", "left").withColumn("_g", F.coalesce("component", "_key"))
    groups = of.groupBy("_g").agg(F.min("_first").alias("group_id"), F.sum("_n").alias("group_size"))
    named = of.select("_key", "_g").join(groups, "_g").select("_key", "group_id", "group_size")
    out = rows.join(named, "_key")
    return out.select("doc_id", "group_id", "group_size", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("kept"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, all their columns, one for each group: the one with the smallest doc_id (nulls last), then the
    smallest MD5 over the whole row, in which null differs from empty. Columns of any name may come along."""
    columns = docs.columns
    _, found = near_classes(docs, **settings)
    names = [f"_sm{i}" for i in range(len(columns))]
    own = docs.select(*[quoted(c).alias(n) for c, n in zip(columns, names)], "text", row_key(docs, columns).alias("_row"), F.col("doc_id").alias("_doc"))
    keyed = classes(own, [*names, "_row", "_doc"])
    order = F.struct(F.col("_doc").isNull().alias("x"), F.col("_doc").alias("d"), F.col("_row").alias("r"))
    firsts = keyed.groupBy("_key").agg(F.min(order).alias("_f"))
    of = firsts.join(found.withColumnRenamed("id", "_key"), "_key", "left").withColumn("_g", F.coalesce("component", "_key"))
    best = of.groupBy("_g").agg(F.min("_f").alias("_f")).select(F.col("_f.r").alias("_br"))
    kept = materialize(keyed.join(best, F.col("_row") == F.col("_br"), "left_semi").select(*names, "_row"), "kept")
    shown = [F.col(n).alias(c) for c, n in zip(columns, names)]
    again = kept.groupBy("_row").count().where("count > 1").select(F.col("_row").alias("_br"))
    again = materialize(again, "kept-equal")  # fully equal rows only
    if not again.limit(1).count():
        return kept.select(*shown)
    same = F.col("_row") == F.col("_br")
    repeated = kept.join(again, same, "left_semi").dropDuplicates(["_row"])
    return kept.join(again, same, "left_anti").unionByName(repeated).select(*shown)


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
