"""SpotSigs document fingerprints: chains of content words that follow common-word anchors.

Anchors are the words with at least SHARE of all word occurrences, found exactly in two passes: a word with that share
has at least half of it in partitions where its own share is above SHARE / 2, so the first pass yields at most
2 / SHARE candidates, which the second counts. Every other word is a content word. A signature is an anchor and the
next CHAIN content words; a fingerprint is the set of a text's signatures. Fingerprints are compared by Jaccard,
pruned by set length: sets whose lengths differ too much can't reach a threshold, so sets meet within partitions of
set length only, through the prefixes of their signatures, rarest first.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, components, deal, in_key_order, materialize, mix64, small_batches, spread_join, table, texts_of, tidy
from .minhash import _across as across
from .minhash import odd_sketch

SHARE = 1 / 1000
CHAIN = 2
THRESHOLD = 0.8
#: Counters of the sketch that orders signatures by how many sets have them: 2 MB on the driver and in each worker.
COUNTERS = 1 << 18
#: Sets whose signatures are counted at once, since each count takes a pass over all counters.
TOGETHER = 256


def anchors(docs: DataFrame, share: float = SHARE) -> list[str]:
    """All words with at least `share` of all occurrences over the whole table, sorted; at most 1 / share."""

    def candidates(batches):
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for t in texts_of(batch):
                seen.update(t.split())
        n = sum(seen.values())
        own = [(w, k) for w, k in seen.items() if k >= share / 2 * n]
        yield pa.RecordBatch.from_pydict({"word": pa.array([None, *(w for w, _ in own)], pa.string()), "n": pa.array([n, *(k for _, k in own)], pa.int64())})

    got = docs.select("text").mapInArrow(candidates, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = materialize(got, "anchor-candidates")
    total = got.where("word is null").agg(F.sum("n")).first()[0] or 0
    likely = {r["word"] for r in got.where(F.col("word").isNotNull() & (F.col("n") >= share / 2 * total)).collect()}  # 2 / share at most

    def counts(batches):
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for t in texts_of(batch):
                seen.update(filter(likely.__contains__, t.split()))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    if not likely:
        return []
    exact = docs.select("text").mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sorted(r["word"] for r in exact.where(F.col("n") >= share * total).collect())


class Fingerprinter:
    def __init__(self, anchor_words: list[str], chain: int = CHAIN):
        from xxhash import xxh3_64_intdigest

        common = frozenset(anchor_words)
        self.hashes = Cache(lambda w: xxh3_64_intdigest(w) & ~1 | (w in common), 600_000)
        self.chain = chain

    def __call__(self, text: str) -> np.ndarray:
        """The sorted distinct signatures (32 bits). A text without a whole chain has one signature of all its words,
        a text without words none."""
        words = text.split()
        if not words:
            return np.zeros(0, dtype=np.uint32)
        h = np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        is_anchor = (h & np.uint64(1)).astype(bool)
        content = np.nonzero(~is_anchor)[0]
        at = np.nonzero(is_anchor)[0]
        first = np.searchsorted(content, at)
        whole = first + self.chain <= len(content)
        at, first = at[whole], first[whole]
        with np.errstate(over="ignore"):
            if len(at):
                sig = h[at]
                for k in range(self.chain):
                    sig = mix64(sig * np.uint64(0x9E3779B97F4A7C15) + h[content[first + k]])
            else:
                sig = np.array([int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=8).digest(), "little")], dtype=np.uint64)
        return np.unique((sig >> np.uint64(32)).astype(np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Likeness of two sorted sets; below `least` by length alone, 0 at once. Two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def shown(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def signatures_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint or ""), dtype="<u4")


def fingerprint(docs: DataFrame, columns: list[str], share: float = SHARE) -> DataFrame:
    """The given columns, fingerprint and set_length of each row."""
    made = anchors(docs, share)

    def run(batches):
        import pyarrow as pa

        sign = Fingerprinter(made)
        for batch in batches:
            got = [sign(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([shown(g) for g in got], pa.string()), pa.array([len(g) for g in got], pa.int32())], [*columns, "fingerprint", "set_length"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*columns, "text").mapInArrow(run, f"{kinds}, fingerprint string, set_length int")


def rarity(sets: DataFrame) -> np.ndarray:
    """COUNTERS counts of the signatures of all sets (`s`, 32-bit integers), each in the counter that its hash names. A full
    sketch still gives one order for all sets, so that what shares signatures meets; it only prunes less."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                some = np.frombuffer(b"".join(batch.column(0).slice(i, TOGETHER).to_pylist()), "<u4")
                counts += np.bincount(counter(some), minlength=COUNTERS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["c", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for c, n in sets.select("s").mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n")).collect():  # COUNTERS rows at most
        out[c] = n
    return out


def counter(signatures: np.ndarray) -> np.ndarray:
    return (mix64(signatures.astype(np.uint64) + np.uint64(1)) % np.uint64(COUNTERS)).astype(np.int64)


def buckets(sets: DataFrame, threshold: float) -> DataFrame:
    """(_key, band) of sets (_key, `s`): the buckets in which sets at least `threshold` alike are sure to meet.

    Set lengths are cut into partitions by powers of 1 / threshold; a set is in its own partition and in the next. Within
    one, two sets above the threshold share a signature among the first n - ceil(threshold n) + 1 of each in any common
    order, here the rarest first. Empty sets are in none. Signatures in the prefix of one set alone, which most are, go by a
    count before partitions double the rows."""
    counts = sets.sparkSession.sparkContext.broadcast(rarity(sets))

    @F.pandas_udf("array<int>")
    def own(s):
        import pandas as pd

        def prefix(x):
            x = np.frombuffer(x, "<u4")
            order = np.lexsort((x, counts.value[counter(x)]))
            return x[order[: len(x) - math.ceil(threshold * len(x) - 1e-9) + 1]].view(np.int32)

        return pd.Series([prefix(x) for x in s], dtype=object)

    part = F.floor(F.log(F.length("s") / 4) / math.log(1 / threshold) + 1e-9)
    found = materialize(sets.where(F.length("s") > 0).select("_key", part.cast("int").alias("p"), own("s").alias("own")), "spot-prefixes")  # read twice
    keyed = found.select("_key", "p", F.explode("own").alias("sig")).withColumn("sig", F.col("sig").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    shared = keyed.groupBy(F.col("sig").alias("_sig")).count().where("count > 1").select("_sig")  # a set has a signature once
    both = spread_join(keyed, shared, "sig", "_sig", "_key")
    return both.select("_key", F.explode(F.array("p", F.col("p") + 1)).alias("p"), "sig").select("_key", (F.shiftleft(F.col("p").cast("long"), 32) + F.col("sig")).alias("band"))


def linked(pairs: DataFrame, sets: DataFrame, threshold: float, name: str) -> DataFrame:
    """The pairs (a, b) of keys whose sets (_key, `s`) are at least `threshold` alike, exactly."""

    @F.pandas_udf("boolean")
    def alike(x, y):
        import pandas as pd

        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")
            both = 0 if min(len(p), len(q)) < threshold * max(len(p), len(q)) - 1e-9 else len(np.intersect1d(p, q, assume_unique=True))
            out.append(both >= threshold * (len(p) + len(q) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    both = pairs.join(sets.select(F.col("_key").alias("a"), F.col("s").alias("_sa")), "a").join(sets.select(F.col("_key").alias("b"), F.col("s").alias("_sb")), "b")
    return materialize(both.where(alike("_sa", "_sb")).select("a", "b"), f"{name}-links")


def similar_pairs(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, likeness) over distinct fingerprints with likeness >= threshold; prints: fingerprint. Copies are one fingerprint.

    All links as rows, so for tables without large families of near copies; near_groups finds their groups without."""
    sets = prints.select("fingerprint").distinct().withColumn("_key", F.col("fingerprint")).withColumn("s", F.unbase64("fingerprint"))
    found = buckets(sets, threshold)
    pairs = found.select(F.col("_key").alias("a"), "band").join(found.select(F.col("_key").alias("b"), "band"), "band").where("a < b").select("a", "b").distinct()

    @F.pandas_udf("double")
    def likeness(a, b):
        import pandas as pd

        return pd.Series([jaccard(signatures_of(x), signatures_of(y), threshold) for x, y in zip(a, b)], dtype=float)

    return pairs.withColumn("likeness", likeness("a", "b")).where(F.col("likeness") >= threshold)


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """doc_id, fingerprint_key (128 bits of the fingerprint, hex), group_id (the smallest doc_id of the group), group_size of
    every row. A group is what fingerprints at least `threshold` alike connect; equal fingerprints are alike.

    Null texts count as empty; texts without words have the empty fingerprint and are one group, whose doc_ids may all be
    null as those of any other; repeated rows are rows of their text's group; an empty table gives no rows.

    Fingerprints meet in buckets of set length and rare signature. Each is compared with its bucket's centre; only members
    other than the centre that are still apart meet in blocks, where parity sketches rule most out. So no bucket writes all
    its pairs, none is cut, and only pairs that are compared become rows."""
    small_batches(docs.sparkSession)
    made = anchors(docs, share)

    def run(batches):
        import pyarrow as pa

        sign, seen = Fingerprinter(made), set()
        for batch in batches:
            keys, sets = [], []
            for t in texts_of(batch):
                s = sign(t).astype("<u4").tobytes()
                keys.append(hashlib.blake2b(s, digest_size=16).digest())
                sets.append(None if keys[-1] in seen else s)
                seen.add(keys[-1])
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "_key", "s"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, _key binary, s binary"), "spots")
    sets = materialize(rows.where("s is not null").groupBy("_key").agg(F.first("s").alias("s")), "spot-sets")
    own = materialize(buckets(sets, threshold), "spot-buckets")
    centres = own.groupBy("band").agg(F.min("_key").alias("_c"), F.max("_key").alias("_z")).where("_c <> _z").select(F.col("band").alias("_band"), "_c")
    shared = materialize(spread_join(own, centres, "band", "_band", "_key").select("_key", "band", "_c"), "spot-centres")
    nodes = shared.select(F.col("_key").alias("id")).distinct()

    @F.pandas_udf("binary")
    def sketch(s):
        import pandas as pd

        return pd.Series([odd_sketch(np.frombuffer(x, "<u4").astype(np.uint64)) for x in s], dtype=object)

    compared = materialize(sets.join(nodes.select(F.col("id").alias("_key")), "_key", "left_semi"), "spot-compared")
    star = shared.where("_key <> _c").select(F.col("_c").alias("a"), F.col("_key").alias("b")).distinct()
    links = linked(star, compared, threshold, "spot-star")
    found = materialize(components(nodes, links, "spot-star"), "spot-star-components")
    placed = others_placed(shared, found)
    mixed = placed.groupBy("band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("band")
    rest = materialize(placed.join(mixed, "band", "left_semi"), "spot-apart")
    known = compared.join(rest.select("_key").distinct(), "_key", "left_semi").select("_key", (F.length("s") / 4).cast("int").alias("size"), sketch("s").alias("sketch"))
    more = materialize(across(rest.join(known, "_key"), threshold), "spot-rest")
    more_links = linked(more, compared, threshold, "spot-rest")
    if more_links.limit(1).count():
        found = materialize(components(nodes, links.unionByName(more_links), "spots"), "spot-components")
    sums = rows.groupBy("_key").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n"))
    of = sums.join(found.select(F.col("id").alias("_key"), "component"), "_key", "left").withColumn("_g", F.coalesce("component", "_key"))
    groups = of.groupBy("_g").agg(F.min("_first").alias("group_id"), F.sum("_n").alias("group_size"))
    named = of.select(F.col("_key").alias("_k"), "_g").join(groups, "_g").select("_k", "group_id", "group_size")
    return spread_join(rows.select("doc_id", "_key"), named, "_key", "_k", "doc_id").select("doc_id", F.lower(F.hex("_key")).alias("fingerprint_key"), "group_id", "group_size")


def others_placed(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(band, _key, component) of the members of each bucket that aren't its centre: those have all been compared with it, so
    two in a bucket, as most are, have nothing left to compare."""
    return shared.where("_key <> _c").join(found.select(F.col("id").alias("_key"), "component"), "_key").select("band", "_key", "component")


def against_edited(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, set_length of every row.

    The next document is the one before it in doc_id; rows with equal doc_ids follow each other by a hash of the text, null doc_ids
    come last, the last row is followed by the first; a single row by itself. Null texts count as empty. Each range of
    doc_ids also gets the row that follows its last one, so texts are shuffled once."""
    made = anchors(docs, share)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt, blocks = in_key_order(rows, "doc_id", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # the highest row of each block follows the lowest row of the block above: a row for each block
    tops = dealt.groupBy("_block").agg(F.max(F.struct("doc_id", "_tie")).alias("_top")).collect()
    full = sorted(r["_block"] for r in tops)
    if not full:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, set_length int")
    top_of = {r["_block"]: r["_top"] for r in tops}
    above = docs.sparkSession.createDataFrame([(b, top_of[b]["doc_id"], top_of[b]["_tie"], up) for b, up in zip(full, [*full[1:], full[0]])], f"_b int, _top {kind}, _top_tie long, _above int")
    # the first in order among equal rows; the small side has a row for each block
    edge = dealt.join(F.broadcast(above), (F.col("_block") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_top")) & (F.col("_tie") == F.col("_top_tie")))
    edge = edge.groupBy("_above", "doc_id", "_tie").agg(F.max("text").alias("text")).select("doc_id", "text", "_tie", F.col("_above").alias("_block"), F.lit(1).alias("_edge"))
    both = dealt.withColumn("_edge", F.lit(0)).unionByName(edge)

    def run(batches):
        import pyarrow as pa

        sign = Fingerprinter(made)
        out: dict[str, list] = {}

        def emit(own, follower):
            (key, text, fp), (_, nxt, nfp) = own, follower
            cut = len(text) // 3
            edited = text[: len(text) - cut] + nxt[:cut]
            efp = sign(edited) if cut else fp
            for name, v in (("doc_id", key), ("n_chars", len(text)), ("edited_sha256", hashlib.sha256(edited.encode()).hexdigest()), ("fingerprint", shown(fp)), ("edited_fingerprint", shown(efp)), ("near_edited", jaccard(fp, efp)), ("near_next", jaccard(fp, nfp)), ("set_length", len(fp))):
                out.setdefault(name, []).append(v)

        held = None
        block = None
        for batch in batches:
            for key, text, b, is_edge in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if b != block:
                    held, block = None, b
                now = (key, text, sign(text))
                if held is not None:
                    emit(held, now)
                held = None if is_edge else now
            if out:
                yield pa.RecordBatch.from_pydict({n: pa.array(v, type=kinds[n]) for n, v in out.items()})
                out = {}

    from pyspark.sql.pandas.types import to_arrow_type

    import pyarrow as pa

    kinds = {"doc_id": to_arrow_type(docs.schema["doc_id"].dataType), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "set_length": pa.int32()}
    order = ["_edge", F.col("doc_id").desc_nulls_last(), F.col("_tie").desc(), F.col("text").desc()]
    return deal(both.select("doc_id", "text", "_block", "_edge", "_tie"), blocks, order).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, set_length int")


def op9_spotsigs(spark, sf_dir: str) -> DataFrame:
    return against_edited(table(spark, sf_dir, "documents"))


def spotsigs_groups(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
