"""Packed genotypes: a row for each sample with its dosages as bytes, and for each estimator blocks of its samples.

Calls cross the network once, as rows, when they are packed. From then on a cell is a byte, a block holds CELLS of them at
most, and whatever is needed of an estimator's patch (counts, histograms, Gram tiles, scores) is summed over its blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: The code of a missing call; 0, 1 and 2 are dosages.
MISSING = 3
#: Cells (samples x variants) of one block.
CELLS = 4 << 20
#: Variants of one row of a sum, so that no row or key of a sum grows with the patch.
TILE = 2048
#: Bytes of sums that a task holds before it hands them on.
HELD = 256 << 20
BLOCKS = "estimator_idx int, n int, ids binary, y binary, weight binary, offset binary, check binary, codes binary"


def pack(calls: DataFrame, ids: list[int], everyone: bool = False) -> DataFrame:
    """(sample_idx, codes): of each sample with calls, a byte for each variant of `ids` in that order. Calls that are null or
    absent are MISSING; dosages other than 0, 1 and 2 are an error; of repeated calls one stays. With `everyone` samples that have calls of other variants alone get a row too."""
    spark, m = calls.sparkSession, len(ids)
    places = spark.createDataFrame([(int(v), i) for i, v in enumerate(ids)], "_v long, _place int")
    code = F.when(F.col("dosage").isNull(), MISSING).when(F.col("dosage").isin(0, 1, 2), F.col("dosage")).otherwise(F.raise_error(F.lit("a dosage is 0, 1 or 2")).cast("int"))
    rows = calls.join(F.broadcast(places), F.col("variant_idx") == F.col("_v")).select("sample_idx", "_place", code.cast("byte").alias("_code"))  # as many places as the patches have variants

    if everyone:
        rows = rows.unionByName(calls.select("sample_idx").distinct().select("sample_idx", F.lit(m).alias("_place"), F.lit(MISSING).cast("byte").alias("_code")))

    def run(batches):
        import pyarrow as pa

        own, row = None, None

        def out(ids, rows):
            return pa.RecordBatch.from_pydict({"sample_idx": pa.array(ids, pa.int64()), "codes": pa.array(rows, pa.binary())})

        for batch in batches:
            s, place, codes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(np.diff(s)) + 1
            done_ids, done = [], []
            for a, b in zip([0, *cuts], [*cuts, len(s)]):
                if a == b:
                    continue
                if s[a] != own:
                    if own is not None:
                        done_ids.append(own)
                        done.append(row[:m].tobytes())
                    own, row = s[a], np.full(m + 1, MISSING, np.uint8)  # the last one for samples without calls
                row[place[a:b]] = codes[a:b]
            for k in range(0, len(done), 256):
                yield out(done_ids[k : k + 256], done[k : k + 256])
        if own is not None:
            yield out([own], [row[:m].tobytes()])

    return rows.repartition("sample_idx").sortWithinPartitions("sample_idx").mapInArrow(run, "sample_idx long, codes binary")


def blocks(packed: DataFrame, people: DataFrame, places: dict[int, np.ndarray]) -> DataFrame:
    """Blocks of each estimator's patch: packed rows of the samples in `people` (sample_idx, estimators array, y, weight,
    offset, check) and the columns `places` of its variants. A block is a row; codes are variants x samples."""
    joined = packed.join(people, "sample_idx").select("sample_idx", "codes", "estimators", "y", "weight", "offset", "check")

    def run(batches):
        import pyarrow as pa

        held: dict[int, list] = {}

        def block(e):
            ids, codes, y, w, o, c = zip(*held.pop(e))
            made = [e, len(ids), np.array(ids, np.int64).tobytes(), *[np.array(v, np.float64).tobytes() for v in (y, w, o)], np.array(c, np.bool_).tobytes(), np.stack(codes, axis=1).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, [pa.int32(), pa.int32(), *[pa.binary()] * 6])], names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for at in range(batch.num_rows):
                sample, codes, estimators, y, w, o, c = (batch.column(i)[at].as_py() for i in range(7))
                whole = np.frombuffer(codes, np.uint8)
                for e in estimators:
                    held.setdefault(e, []).append((sample, whole[places[e]], y, w, o, c))
                    if len(held[e]) * max(1, len(places[e])) >= CELLS:
                        yield block(e)
        for e in list(held):
            yield block(e)

    return joined.mapInArrow(run, BLOCKS)


@dataclass
class Block:
    estimator: int
    ids: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    offset: np.ndarray
    check: np.ndarray
    codes: np.ndarray


def unpacked(row: dict) -> Block:
    n = row["n"]
    vec = lambda name: np.frombuffer(row[name], np.float64)
    return Block(row["estimator_idx"], np.frombuffer(row["ids"], np.int64), vec("y"), vec("weight"), vec("offset"), np.frombuffer(row["check"], np.bool_), np.frombuffer(row["codes"], np.uint8).reshape(-1, n))


def each_block(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            yield unpacked({f: batch.column(i)[at].as_py() for i, f in enumerate(batch.schema.names)})


def narrowed(made: DataFrame, kept: dict[int, np.ndarray]) -> DataFrame:
    """The same blocks with only the given columns of each estimator."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                row = {f: batch.column(i)[at].as_py() for i, f in enumerate(batch.schema.names)}
                row["codes"] = unpacked(row).codes[kept[row["estimator_idx"]]].tobytes()
                yield pa.RecordBatch.from_pydict({f: pa.array([v], batch.schema.field(f).type) for f, v in row.items()})

    return made.mapInArrow(run, BLOCKS)


def summed(made: DataFrame, part, finish=None, schema: str = "estimator_idx int, tile int, node int, sums binary") -> DataFrame:
    """Sums over blocks by (estimator, tile, node). part(block) yields (tile, node, array of doubles); a task adds up what
    it has of a key and the keys' partial sums meet in the shuffle, one key at a time in memory. `finish` gets
    ((estimator, tile), {node: sum}) and yields rows of `schema`; without it the sums themselves are rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    form = to_arrow_schema(made.sparkSession.createDataFrame([], schema).schema)
    partial = pa.schema([("estimator_idx", pa.int32()), ("tile", pa.int32()), ("node", pa.int32()), ("sums", pa.binary())])

    def rows(held):
        for (e, t, k), v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([x], ty) for x, ty in zip((e, t, k, v.tobytes()), partial.types)], schema=partial)

    def local(batches):
        held, size = {}, 0
        for block in each_block(batches):
            for tile, node, v in part(block):
                key = (block.estimator, tile, node)
                if key in held:
                    held[key] += v
                else:
                    held[key] = np.array(v, np.float64)
                    size += held[key].nbytes
            if size > HELD:
                yield from rows(held)
                held, size = {}, 0
        yield from rows(held)

    def total(batches):
        own, nodes = None, {}
        for batch in batches:
            for e, t, k, v in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (e, t) != own:
                    if own is not None:
                        yield from ended(own, nodes)
                    own, nodes = (e, t), {}
                v = np.frombuffer(v, np.float64)
                nodes[k] = nodes[k] + v if k in nodes else v
        if own is not None:
            yield from ended(own, nodes)

    def ended(own, nodes):
        if finish is None:
            yield from rows({(*own, k): v for k, v in nodes.items()})
            return
        out = list(finish(own, nodes))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=form)

    parts = made.mapInArrow(local, "estimator_idx int, tile int, node int, sums binary")
    return parts.repartition("estimator_idx", "tile").sortWithinPartitions("estimator_idx", "tile", "node").mapInArrow(total, schema)


def tiles(m: int, size: int) -> list[tuple[int, int, int]]:
    return [(t, t * size, min(m, (t + 1) * size)) for t in range(-(-m // size))]


def values(maf: np.ndarray, a0: np.ndarray) -> np.ndarray:
    """variants x 4: what each code is worth, as qc.standardize has it: centred on A0, scaled by sqrt(2 maf (1 - maf));
    missing calls and variants without a MAF are 0."""
    with np.errstate(invalid="ignore"):
        sd = np.sqrt(2 * maf * (1 - maf))
        x = (np.arange(3) - 2 * a0[:, None]) / np.where(sd == 0, 1.0, sd)[:, None]
    return np.column_stack([np.nan_to_num(x, nan=0.0), np.zeros(len(maf))])


def moments(made: DataFrame, classes_of_y: list[float] | None = None, finish=None, schema: str | None = None) -> DataFrame:
    """(estimator_idx, tile, sums) with sums (4 codes x k x variants of the tile): of the rows with each code their number,
    sum of y and sum of y squared, where `classes_of_y` gives bounds the number in each class of y, all without the rows that
    check, and last the number of all rows."""

    def part(b):
        columns = [np.ones(len(b.y)), b.y, b.y * b.y]
        if classes_of_y is not None:
            at = np.searchsorted(classes_of_y, b.y, side="left")
            columns += [(at == c).astype(float) for c in range(len(classes_of_y) + 1)]
        w = np.stack([np.where(b.check, 0.0, c) for c in columns] + [np.ones(len(b.y))], axis=1)
        for t, lo, hi in tiles(len(b.codes), TILE):
            yield t, 0, np.stack([((b.codes[lo:hi] == c).astype(float) @ w).T for c in range(4)]).ravel()

    return summed(made, part) if finish is None else summed(made, part, finish, schema)


def scores_of(how: str, sums: np.ndarray, x: np.ndarray, classes: bool) -> np.ndarray:
    """A score for each variant from its moments (4 x k x variants); x is variants x 4. Larger is better."""
    n, sy, syy = sums[:, 0], sums[:, 1], sums[:, 2]
    total, xs = n.sum(axis=0), x.T
    mx = (n * xs).sum(axis=0) / total
    my = sy.sum(axis=0) / total
    vx = (n * xs * xs).sum(axis=0) / total - mx * mx
    vy = syy.sum(axis=0) / total - my * my
    cov = (sy * xs).sum(axis=0) / total - mx * my
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where((vx > 1e-12) & (vy > 1e-12), cov / np.sqrt(np.maximum(vx, 0) * np.maximum(vy, 0)), np.nan)
        if how == "variance":
            return vx
        if how == "r_regression":
            return r
        if how == "chi2":  # dosage sums by class against the classes' shares
            dose = np.arange(3.0)[:, None]
            seen = np.stack([(dose * (n - sy)[:3]).sum(axis=0), (dose * sy[:3]).sum(axis=0)])
            share = np.stack([(n - sy)[:3].sum(axis=0), sy[:3].sum(axis=0)]) / n[:3].sum(axis=0)
            want = share * seen.sum(axis=0)
            return np.where(seen.sum(axis=0) > 0, ((seen - want) ** 2 / want).sum(axis=0), np.nan)
        if how == "mutual_info":
            joint = (np.stack([n - sy, sy], axis=1) if classes else sums[:, 3:-1]) / total
            rows, columns = joint.sum(axis=1, keepdims=True), joint.sum(axis=0, keepdims=True)
            return np.nansum(np.where(joint > 0, joint * np.log(joint / (rows * columns)), 0.0), axis=(0, 1))
        f = r * r / (1 - r * r) * (total - 2)  # of two classes or of values alike
        return np.where(np.isnan(f) & (r * r >= 1), np.inf, f)


def scored(made: DataFrame, how: str, x: dict[int, np.ndarray], classes: bool, bounds: list[float] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each estimator the scores of its variants and which codes they have (variants x 4), worked out where the moments
    meet; nine bytes of each variant reach the driver."""

    def finish(key, nodes):
        e, t = key
        lo = t * TILE
        m = min(TILE, len(x[e]) - lo)
        sums = nodes[0].reshape(4, -1, m)
        yield {"estimator_idx": e, "tile": t, "scores": scores_of(how, sums, x[e][lo : lo + m], classes).tobytes(), "present": (sums[:, -1] > 0).T.tobytes()}

    rows = moments(made, bounds if how == "mutual_info" and not classes else None, finish, "estimator_idx int, tile int, scores binary, present binary").collect()
    out = {}
    for e in {r["estimator_idx"] for r in rows}:
        own = sorted((r for r in rows if r["estimator_idx"] == e), key=lambda r: r["tile"])
        out[e] = np.concatenate([np.frombuffer(r["scores"]) for r in own]), np.concatenate([np.frombuffer(r["present"], np.bool_).reshape(-1, 4) for r in own])
    return out


def patch_blocks(calls: DataFrame, people: DataFrame, own: DataFrame, ids: list[int], places: dict[int, np.ndarray]) -> DataFrame:
    """The blocks of all estimators, written: `own` (estimator_idx, sample_idx), `people` (sample_idx, y and, if they are
    there, weight, offset, check), `places` each estimator's columns among the variants `ids`."""
    d = F.lit(0.0)
    known = people.select(
        "sample_idx", F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("weight") if "weight" in people.columns else F.lit(1.0).alias("weight"),
        F.col("offset").cast("double").alias("offset") if "offset" in people.columns else d.alias("offset"), F.col("check").cast("boolean").alias("check") if "check" in people.columns else F.lit(False).alias("check"),
    )
    plan = own.groupBy("sample_idx").agg(F.collect_list("estimator_idx").alias("estimators")).join(known, "sample_idx")  # as many as estimators at most
    return cut(blocks(pack(calls.join(plan.select("sample_idx"), "sample_idx", "left_semi"), ids), plan, places))
