"""Embedding near-dedup by lattice hashing on E8.

Distinct vectors of a label (copies are one) are scaled to length 1. In each of several tables a random projection to
two times eight dimensions is decoded to the nearest points of two E8 lattices, which together are the vector's cell; it
also probes the next nearest cells. Vectors that meet in a cell are candidates; their cosine is computed in double
precision where they meet, once for all cells with the same members. Members of a cell meet in blocks, block against
block, so that a crowded cell is many bounded steps and no candidate is written down.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, mix64, table

COSINE = 0.93
TABLES = 10
LATTICES = 2
SCALE = 0.6
PROBES = 6
BLOCK = 256


def _nearest_d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points of D8 (integers with even sum) and the offsets from them."""
    r = np.rint(x)
    d = x - r
    odd = (r.sum(axis=1).astype(np.int64) & 1).astype(bool)
    k = np.argmax(np.abs(d), axis=1)
    rows = np.nonzero(odd)[0]
    step = np.where(d[rows, k[rows]] >= 0, 1.0, -1.0)
    r[rows, k[rows]] += step
    return r, x - r


def e8_cells(x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest E8 points of each row, nearest first, doubled to integers: (rows, 1 + probes, 8), and their distances.

    E8 is D8 and D8 shifted by one half. Candidates are the nearest point of each coset and the points one even step
    in the two least certain of its coordinates away from it."""
    near = []
    for shift in (0.0, 0.5):
        r, d = _nearest_d8(x - shift)
        r = r + shift
        near.append(r)
        order = np.argsort(-np.abs(d), axis=1)
        rows = np.arange(len(x))
        for i, j in ((0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (0, 4), (2, 3)):
            p = r.copy()
            for c in (order[:, i], order[:, j]):
                p[rows, c] += np.where(d[rows, c] >= 0, 1.0, -1.0)
            near.append(p)
    all_points = np.stack(near, axis=1)
    dist = ((all_points - x[:, None, :]) ** 2).sum(axis=2)
    best = np.argsort(dist, axis=1, kind="stable")[:, : 1 + probes]
    return np.rint(2 * np.take_along_axis(all_points, best[:, :, None], axis=1)).astype(np.int64), np.take_along_axis(dist, best, axis=1)


def cell_keys(x: np.ndarray, probes: int, seed: int) -> np.ndarray:
    """Hashes of the nearest cells of each row, nearest first: (rows, 1 + probes). A row holds 8 coordinates for each of
    its lattices; a cell is a point of each, and the nearest cells are those with the least sum of distances."""
    keys = dist = None
    rng = np.random.default_rng(seed)
    for k in range(x.shape[1] // 8):
        points, far = e8_cells(x[:, 8 * k : 8 * k + 8], probes)
        with np.errstate(over="ignore"):
            own = (points.astype(np.uint64) * (rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(axis=2)
            if keys is not None:
                own = (keys[:, :, None] + own[:, None, :]).reshape(len(x), -1)
                far = (dist[:, :, None] + far[:, None, :]).reshape(len(x), -1)
        best = np.argsort(far, axis=1, kind="stable")[:, : 1 + probes]
        keys, dist = np.take_along_axis(own, best, axis=1), np.take_along_axis(far, best, axis=1)
    return keys


def projections(dims: int, tables: int, lattices: int, scale: float, seed: int = 8) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, dims, 8 * lattices)) * scale


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the embedding (floats stay floats, other numbers become doubles), null where it can't link: null or no label, empty, zero, or with null or
    non-finite components."""
    e = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    fine = F.col("label").isNotNull() & F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(e, lambda v: v != 0), F.lit(False))
    kept = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else e
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.when(fine, kept).alias("e"))


def _unit(a: np.ndarray) -> np.ndarray:
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def meetings(reps: DataFrame, cosine: float = COSINE, tables: int = TABLES, scale: float = SCALE, probes: int = PROBES, block: int = BLOCK, lattices: int = LATTICES) -> DataFrame:
    """What linked pairs (one label and length, cosine >= `cosine`) of rows (rep, label, e, n) come to, without a row for each:
    (a, null, n) where a is linked with rows of together n, to be summed up, and (a, b, null), links that hold together
    what all links do.

    Only cells that a home and another vector share go on, and of cells with the same members only one. A cell's members
    are dealt over blocks of about `block`, and every two blocks meet in a step of their own, which holds those two only.
    A pair that meets in several cells counts in the one with the smallest number."""

    def keyed(batches):
        import pyarrow as pa

        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, labels, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2)
            dims_of = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims_of) - dims_of
            for dims in np.unique(dims_of).tolist():
                own = np.nonzero(dims_of == dims)[0]
                if dims not in planes:
                    planes[dims] = projections(dims, tables, lattices, scale)
                for part in np.array_split(own, -(-len(own) // 2000)):
                    x = _unit(flat[starts[part][:, None] + np.arange(dims)].astype(np.float64))
                    cells = []
                    for t in range(tables):
                        with np.errstate(over="ignore"):
                            salt = mix64(labels[part] + np.uint64(t * 65_537 + dims) * np.uint64(0x9E3779B97F4A7C15))
                            cells.append(mix64(cell_keys(x @ planes[dims][t], probes, t) ^ salt[:, None]))
                    cell = (np.stack(cells, axis=1) >> np.uint64(1)).astype(np.int64)
                    probe = np.broadcast_to(np.arange(cell.shape[2]) > 0, cell.shape)
                    rep = np.broadcast_to(ids[part][:, None, None], cell.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), pa.array(rep.ravel()), pa.array(probe.ravel())], ["cell", "rep", "probe"])

    cells = materialize(reps.select("rep", F.xxhash64(F.col("label").cast("string")).alias("label"), "e").mapInArrow(keyed, "cell long, rep long, probe boolean"), "cells")
    shared = cells.groupBy("cell").agg(F.count("*").alias("_n"), F.min("probe").alias("_no_home"), F.bit_xor(F.xxhash64("rep")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("_y"))
    shared = shared.where("_n > 1 and not _no_home").groupBy("_n", "_x", "_y").agg(F.min("cell").alias("_cell")).select("_cell", "_n")
    member = materialize(cells.join(shared, F.col("cell") == F.col("_cell")).select("cell", "rep", F.ceil(F.col("_n") / block).cast("int").alias("_k")), "cell-members")
    wide = reps.select("rep", F.col("label").cast("string").alias("label"), "e", "n").join(member.groupBy(F.col("rep").alias("_r")).agg(F.collect_list("cell").alias("cells")), F.col("rep") == F.col("_r")).drop("_r")
    member = member.withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_k")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    member = member.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
    member = member.join(wide, "rep")
    meeting = ["cell", "_i", "_j"]
    met = member.select(*meeting, (F.col("_own") == F.col("_j")).alias("late"), "rep", "label", "n", "cells", "e").repartition(*meeting).sortWithinPartitions(*meeting)

    def verified(batches):
        import pyarrow as pa

        key, held = None, []

        def pairs():
            late, rep, label, n, cells = (list(c) for c in list(zip(*held))[:5])
            late, rep, label, n = np.array(late), np.array(rep), np.array(label), np.array(n)
            by_dims: dict[int, list[int]] = {}
            for at, row in enumerate(held):
                by_dims.setdefault(len(row[5]), []).append(at)
            for own in map(np.array, by_dims.values()):
                x = _unit(np.array([held[at][5] for at in own], dtype=np.float64))
                near = x @ x.T >= cosine - 1e-9
                near &= label[own][:, None] == label[own]
                if key[1] != key[2]:
                    near &= late[own][:, None] != late[own]
                i, j = np.nonzero(np.triu(near, 1))
                sure = (x[i] * x[j]).sum(axis=1) >= cosine
                i, j = i[sure], j[sure]
                first = _first_met([cells[at] for at in own], key[0], i, j)
                i, j = i[first], j[first]
                if len(i):
                    links = np.bincount(i, n[own[j]], len(own)) + np.bincount(j, n[own[i]], len(own))
                    on = np.nonzero(links)[0]
                    a, b = _spanning(len(own), i, j)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[own[on]], rep[own[a]]]), pa.int64()), pa.array([None] * len(on) + rep[own[b]].tolist(), pa.int64()), pa.array(links[on].astype(np.int64).tolist() + [None] * len(a), pa.int64())], ["a", "b", "n"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            vectors = batch.column(8)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *vectors.value_lengths().to_pylist()])
            for at, (cell, i, j, *row) in enumerate(zip(*columns)):
                if (cell, i, j) != key:
                    if len(held) > 1:
                        yield from pairs()
                    key, held = (cell, i, j), []
                held.append((*row, flat[ends[at] : ends[at + 1]]))
        if len(held) > 1:
            yield from pairs()

    return met.mapInArrow(verified, "a long, b long, n long")


def _first_met(cells: list, cell: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs (i, j), those whose lists of cells share none below `cell`."""
    if len(i) <= 300:
        below = [{c for c in x if c < cell} for x in cells]
        return np.array([below[a].isdisjoint(below[b]) for a, b in zip(i.tolist(), j.tolist())], dtype=bool)
    who, what = np.repeat(np.arange(len(cells)), [len(x) for x in cells]), np.concatenate([np.asarray(x, np.int64) for x in cells])
    who, what = who[what < cell], what[what < cell]
    names, code, count = np.unique(what, return_inverse=True, return_counts=True)
    who, code = who[count[code] > 1], code[count[code] > 1]
    shares = np.zeros((len(cells), len(cells)), dtype=bool)
    names, code = np.unique(code, return_inverse=True)
    for k in range(0, len(names), 4096):
        held = (code >= k) & (code < k + 4096)
        grid = np.zeros((len(cells), 4096), dtype=np.float32)
        grid[who[held], code[held] - k] = 1
        shares |= grid @ grid.T > 0
    return ~shares[i, j]


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs out of (i, j), at most n - 1, that connect what all of them connect."""
    up = list(range(n))

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    a, b = [], []
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = root(x), root(y)
        if p != q:
            up[p] = q
            a.append(x)
            b.append(y)
            if len(a) == n - 1:
                break
    return a, b


def near_vectors(vectors: DataFrame, cosine: float = COSINE, **settings) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero or not finite, and those without a label, link with nothing. Equal vectors of one
    label are one class, linked with each other; a class's links count all vectors of the classes it is linked to. Null
    vec_ids count as vectors but name no component: one without other vec_ids has a negative number and keeps one row. An
    empty table gives no rows."""
    rows = materialize(usable(vectors).withColumn("_row", F.monotonically_increasing_id()), "vectors")
    good = rows.where("e is not null").withColumn("_h", F.xxhash64("label", "e")).withColumn("_h2", F.xxhash64(F.lit(7), "label", "e"))
    by_class = good.groupBy("_h", "_h2").agg(F.min("vec_id").alias("_first"), F.count("*").alias("_n"), F.min("_row").alias("_first_row"), F.first(F.struct("label", "e")).alias("_v"))
    by_class = materialize(by_class.select("_h", "_h2", "_n", "_first", "_first_row", F.col("_h").alias("rep"), "_v.label", "_v.e"), "vector-classes")
    met = materialize(meetings(by_class.withColumnRenamed("_n", "n"), cosine, **settings), "vector-links")
    found = met.where("b is not null").select("a", "b")
    linked = met.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("_l"))
    parts = components(by_class.select(F.col("rep").alias("id")), found, "vectors").withColumnRenamed("id", "rep")
    parts = materialize(by_class.select("rep", "_first", "_first_row").join(parts, "rep"), "vector-parts")
    names = parts.groupBy(F.col("component").alias("_c")).agg(F.min("_first").alias("_name"), F.min("_first_row").alias("_keeps"))
    unnamed = -F.shiftrightunsigned("component", 1) - 1
    parts = parts.join(names, F.col("component") == F.col("_c")).select("rep", F.coalesce("_name", unnamed).alias("component"), F.when(F.col("_name").isNull(), F.col("_keeps")).alias("_keeps"))
    named = by_class.select("_h", "_h2", "rep", "_n").join(linked, "rep", "left").join(parts, "rep")
    named = named.select(F.col("_h").alias("_k"), F.col("_h2").alias("_k2"), (F.coalesce("_l", F.lit(0)) + F.col("_n") - 1).alias("_links"), "component", "_keeps")
    out = good.join(named, (F.col("_h") == F.col("_k")) & (F.col("_h2") == F.col("_k2"))).select("vec_id", F.col("_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id").eqNullSafe(F.col("component")) | F.col("_row").eqNullSafe(F.col("_keeps"))).alias("kept"))
    alone = rows.where("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def op8_lattice(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
