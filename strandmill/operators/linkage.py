"""Linkage disequilibrium and simulation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import numbered, with_count
from .storage import cut


#: Samples of one bit plane, and variants of one block.
PLANE, ROWS = 1 << 18, 256
COUNTS = ("n", "a", "aa", "b", "bb", "ab")


def bit_planes(calls: DataFrame) -> DataFrame:
    """(variant_idx, part, planes): of each variant and part of the samples (PLANE indices each) three bit arrays: dosage 1,
    dosage 2, not missing. A call takes three bits from here on."""
    size = PLANE // 8
    code = F.when(F.col("dosage").isin(0, 1, 2), F.col("dosage")).otherwise(F.raise_error(F.lit("a dosage is 0, 1 or 2")).cast("int"))
    rows = calls.where("dosage is not null").select("variant_idx", F.floor(F.col("sample_idx") / PLANE).cast("int").alias("part"), F.pmod("sample_idx", F.lit(PLANE)).cast("int").alias("_bit"), code.cast("byte").alias("_code"))

    def run(batches):
        import pyarrow as pa

        own, planes = None, None

        def out(key, planes):
            last = int(np.flatnonzero(planes[2]).max(initial=0)) // 8 * 8 + 8  # whole words of 64 bits, up to the last call
            return pa.RecordBatch.from_arrays([pa.array([k], t) for k, t in zip((*key, planes[:, :last].tobytes()), (pa.int32(), pa.int32(), pa.binary()))], names=["variant_idx", "part", "planes"])

        for batch in batches:
            v, part, bit, codes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero((np.diff(v) != 0) | (np.diff(part) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(v)]):
                if a == b:
                    continue
                if (v[a], part[a]) != own:
                    if own is not None:
                        yield out(own, planes)
                    own, planes = (v[a], part[a]), np.zeros((3, size), np.uint8)
                mask = (1 << (bit[a:b] % 8)).astype(np.uint8)
                for k, mine in enumerate((codes[a:b] == 1, codes[a:b] == 2, slice(None))):
                    np.bitwise_or.at(planes[k], bit[a:b][mine] // 8, mask[mine])
        if own is not None:
            yield out(own, planes)

    return rows.repartition("variant_idx", "part").sortWithinPartitions("variant_idx", "part").mapInArrow(run, "variant_idx int, part int, planes binary")


def pair_counts(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums over the samples that both variants have, from their planes (3, words): number, a, a squared, b, b squared, ab."""
    count = lambda x, y: np.bitwise_count(x & y).sum(axis=-1, dtype=np.int64)
    a1, a2, ok = left
    b1, b2, there = right[:, 0], right[:, 1], right[:, 2]
    x1, x2, y1, y2 = count(a1, there), count(a2, there), count(b1, ok), count(b2, ok)
    return np.stack([count(ok, there), x1 + 2 * x2, x1 + 4 * x2, y1 + 2 * y2, y1 + 4 * y2, count(a1, b1) + 2 * (count(a1, b2) + count(a2, b1)) + 4 * count(a2, b2)], axis=1)


def ld(calls: DataFrame, v: DataFrame, reach: int, by_number: bool = False) -> DataFrame:
    """(i, j, r2), i before j on one chromosome: squared correlation of the calls of variants at most `reach` apart in position,
    or with by_number in number along the chromosome; null calls are left out, r2 is null where a variant doesn't vary and
    pairs without a common call have no row. i < j but for by_number, where they come in genomic order.

    Variants are numbered in genomic order and cut into blocks of ROWS; blocks near enough meet pair by pair, as bit planes,
    and their variants are compared by AND and popcount. No row of a sample is made, and no task holds more than two blocks.
    """
    placed = cut(numbered(v.select("chr", "pos", "variant_idx"), ["chr", "pos", "variant_idx"], "_at"))
    firsts = placed.groupBy("chr").agg(F.min("_at").alias("_first"))
    along = (F.col("_at") - F.col("_first")) if by_number else F.col("pos")
    placed = placed.join(F.broadcast(firsts), "chr").select("chr", "variant_idx", along.cast("long").alias("_along"), F.floor(F.col("_at") / ROWS).cast("int").alias("_block"))  # a row for each chromosome
    ends = placed.groupBy("chr", "_block").agg(F.min("_along").alias("_lo"), F.max("_along").alias("_hi"))  # ROWS times fewer
    other = ends.select(F.col("chr").alias("_c"), F.col("_block").alias("_t"), F.col("_lo").alias("_lo2"))
    meets = ends.join(other, (F.col("chr") == F.col("_c")) & (F.col("_block") <= F.col("_t")) & (F.col("_lo2") - F.col("_hi") <= reach)).select("chr", F.col("_block").alias("_s"), "_t")
    meets = cut(meets)
    packed = cut(bit_planes(calls.join(placed.select("variant_idx"), "variant_idx", "left_semi")).join(placed, "variant_idx"))
    sides = meets.select(F.col("chr").alias("_c"), "_s", "_t", F.explode(F.when(F.col("_s") == F.col("_t"), F.array("_s")).otherwise(F.array("_s", "_t"))).alias("_side"))
    rows = packed.join(sides, (F.col("chr") == F.col("_c")) & (F.col("_block") == F.col("_side"))).select("chr", "_s", "_t", "part", "_side", "_along", "variant_idx", "planes")

    def run(rows):
        import pandas as pd

        rows = rows.sort_values(["_along", "variant_idx"])
        words = max(len(p) for p in rows["planes"]) // 24
        planes = np.zeros((len(rows), 3, words), np.uint64)
        for k, p in enumerate(rows["planes"]):
            own = np.frombuffer(p, np.uint64).reshape(3, -1)
            planes[k, :, : own.shape[1]] = own
        s, t = int(rows["_s"].iloc[0]), int(rows["_t"].iloc[0])
        side, along, ids = (rows[c].to_numpy() for c in ("_side", "_along", "variant_idx"))
        out = []
        for k in np.flatnonzero(side == s):
            mine = (side == t) & (np.abs(along - along[k]) <= reach)
            if s == t:
                mine[: k + 1] = False
            if mine.any():
                counts = pair_counts(planes[k], planes[mine])
                first, last = np.full(int(mine.sum()), ids[k]), ids[mine]
                swap = (first > last) & (not by_number)
                counts[swap] = counts[swap][:, [0, 3, 4, 1, 2, 5]]
                out.append(pd.DataFrame({"i": np.where(swap, last, first), "j": np.where(swap, first, last), **dict(zip(COUNTS, counts.T))}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("i", "j", *COUNTS)})

    parts = rows.groupBy("chr", "_s", "_t", "part").applyInPandas(run, "i int, j int, " + ", ".join(f"{c} long" for c in COUNTS))
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).cast("double").alias(c) for c in COUNTS]).where("n > 0")
    cov = F.col("n") * F.col("ab") - F.col("a") * F.col("b")
    spread = (F.col("n") * F.col("aa") - F.col("a") * F.col("a")) * (F.col("n") * F.col("bb") - F.col("b") * F.col("b"))
    return sums.select("i", "j", (cov * cov / F.nullif(spread, F.lit(0.0))).alias("r2"))


def best_representative(pairs: DataFrame) -> DataFrame:
    """(snp, rep, r2) of the strongest representative of each variant; the smaller one on ties."""
    return pairs.groupBy("snp").agg(F.max_by("rep", F.struct("r2", (-F.col("rep")).alias("o"))).alias("rep"), F.max("r2").alias("r2"))


def blocks(v: DataFrame, best: DataFrame) -> DataFrame:
    """Adds block_idx: numbers from 0 over the sorted representatives, -1 without one."""
    ids = numbered(best.select("rep").distinct(), ["rep"], "block_idx")
    of = best.join(ids, "rep").select(F.col("snp").alias("variant_idx"), "block_idx")
    return v.join(of, "variant_idx", "left").withColumn("block_idx", F.coalesce("block_idx", F.lit(-1)))


def block_statistics(of: DataFrame) -> DataFrame:
    """(blocks, mean_size, max_size, min_size, unassigned) of rows with block_idx, -1 standing for none."""
    b = of.groupBy("block_idx").agg(F.count("*").alias("n"))
    n = F.when(F.col("block_idx") >= 0, F.col("n"))
    return b.agg(F.count(n).alias("blocks"), F.avg(n).alias("mean_size"), F.max(n).alias("max_size"), F.min(n).alias("min_size"), F.coalesce(F.sum(F.when(F.col("block_idx") < 0, F.col("n"))), F.lit(0)).alias("unassigned"))


def prune(calls: DataFrame, v: DataFrame, window_variants: int, r2: float):
    """Greedy pruning along each chromosome: a variant goes if a kept one within the last `window_variants` variants is
    correlated with it by more than r2. Pairs come from ld(); the greedy pass over a chromosome's short list of
    linked pairs is sequential by definition."""
    near = ld(calls, v, window_variants - 1, by_number=True)
    linked = near.where(F.col("r2") > r2).groupBy(F.col("j").alias("variant_idx")).agg(F.collect_list("i").alias("before"))  # fewer than the window

    def run(rows):
        kept: set[int] = set()
        out = []
        for i, before in zip(rows["variant_idx"], rows["before"]):
            fine = before is None or not any(x in kept for x in before)
            if fine:
                kept.add(i)
            out.append(fine)
        return rows.assign(kept=out)[["variant_idx", "kept"]]

    ordered = v.join(linked, "variant_idx", "left").select("chr", "pos", "variant_idx", "before")
    return ordered.groupBy("chr").applyInPandas(lambda r: run(r.sort_values(["pos", "variant_idx"])), "variant_idx int, kept boolean")


def hash_uniform(*columns, seed) -> Column:
    h = F.conv(F.substring(F.md5(F.concat_ws("_", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)))), 1, 8), 16, 10).cast("double")
    return (h + 0.5) / 4294967296.0


def hash_normal(*columns, seed) -> Column:
    """Box-Muller over two hash uniforms."""
    u, w = hash_uniform(*columns, seed=f"{seed}a"), hash_uniform(*columns, seed=f"{seed}b")
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * w)


def causal_effects(v: DataFrame, share: float, seed: int) -> DataFrame:
    """(variant_idx, beta) of int(share n) variants by hash order, normal with variance 1 / their number."""
    n = F.expr(f"cast(_all * {share}D as int)")
    r = with_count(numbered(v.select("variant_idx", hash_uniform("variant_idx", seed=seed).alias("_u")), ["_u", "variant_idx"], "_i"), _all=F.count("*"))
    return r.where(F.col("_i") < n).select("variant_idx", (hash_normal("variant_idx", seed=seed) / F.sqrt(n)).alias("beta"))


def causal_pairs(v: DataFrame, n: int, seed: int) -> DataFrame:
    """(i, j, alpha) of n pairs: the variants in hash order, paired with their successors."""
    r = cut(numbered(v.select("variant_idx", hash_uniform("variant_idx", seed=f"{seed}p").alias("_u")), ["_u", "variant_idx"], "_i").where(F.col("_i") <= n))
    following = r.select(F.col("variant_idx").alias("_next"), (F.col("_i") - 1).alias("_i"))
    r = r.where(F.col("_i") < n).join(following, "_i")
    return r.select(F.least("variant_idx", "_next").alias("i"), F.greatest("variant_idx", "_next").alias("j")).withColumn("alpha", hash_normal("i", "j", seed=seed) / math.sqrt(n))


def pair_score(x: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sum of alpha x_i x_j by sample."""
    a = x.join(pairs, x.variant_idx == pairs.i).select("sample_idx", "j", "alpha", F.col("x").alias("_a"))
    b = x.select("sample_idx", F.col("variant_idx").alias("j"), F.col("x").alias("_b"))
    return a.join(b, ["sample_idx", "j"]).groupBy("sample_idx").agg(F.sum(F.expr("alpha * _a * _b")).alias("epi"))


def scaled(rows: DataFrame, column: str, h: float, train: str = "split = 'train'") -> DataFrame:
    """The column times sqrt(h) / its deviation over the training rows."""
    s = rows.where(train).agg(F.stddev_pop(column).alias("_s"))
    return rows.crossJoin(F.broadcast(s)).withColumn(column, F.coalesce(F.col(column) * math.sqrt(h) / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(0.0))).drop("_s")


def case_control(rows: DataFrame, column: str, prevalence: float) -> DataFrame:
    """Adds y: above the (1 - prevalence) quantile of all rows."""
    q = rows.agg(F.percentile(column, F.lit(1 - prevalence)).alias("_q"))
    return rows.crossJoin(F.broadcast(q)).withColumn("y", (F.col(column) > F.col("_q")).cast("int")).drop("_q")
