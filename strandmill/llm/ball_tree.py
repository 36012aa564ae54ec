"""Centroid clustering (Lloyd's rounds) filtered through ball trees.

Vectors are integers. Each task cuts its rows into blocks of at most BLOCK vectors and builds a metric tree over each: a ball
keeps its centre, radius, number of vectors and their integer sum. The trees are written once. In a round, a task takes all
the balls of a level at once: a ball none of whose points can be nearer to another centroid (by the triangle inequality, with
a margin over rounding) goes to its centroid as a whole, by its count and sum; others hand their candidates down, and leaves
measure their vectors exactly. Only counts and sums for each centroid leave a task, in integers, so the order of the rows
doesn't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, tidy

BLOCK = 4096
LEAF = 24
ROUNDS = 10
CENTROIDS = 8
#: Components may be so large at most: squared distances of vectors of 64 are then below 2^63.
MOST = 1 << 27
#: Up to here a dot product of 64 components is exact in double precision too, and faster.
EXACT = 1 << 22
TREES = "ids binary, nulls binary, vectors binary, starts binary, ends binary, lefts binary, centres binary, radii binary, sums binary"


def whole(df: DataFrame, vectors: str, size: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors of exactly `size` components, none null or not finite, as integers floor(scale * x)."""
    x = F.col(vectors)
    good = (F.size(x) == size) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = df.where(x.isNotNull() & F.coalesce(good, F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    checked = F.transform(scaled, lambda c: F.when(F.abs(c) > MOST, F.raise_error(F.lit(f"a component is over {MOST}"))).otherwise(c).cast("int"))
    return kept.select("vec_id", checked.alias("v"))


def grown(v: np.ndarray) -> dict[str, np.ndarray]:
    """A metric tree over the rows of v. Nodes come parents first; node k holds rows order[starts[k]:ends[k]], its children
    are lefts[k] and lefts[k] + 1, or it is a leaf (-1). A node is cut at the middle between two far points, in halves where
    that would leave a side empty, and not at all where its vectors are equal."""
    order, x = np.arange(len(v)), v.astype(np.float64)
    starts, ends, lefts, centres, radii, sums = [0], [len(v)], [-1], [], [], []
    k = 0
    while k < len(starts):
        a, b = starts[k], ends[k]
        mine = order[a:b]
        total = v[mine].sum(axis=0, dtype=np.int64)
        centre = total / (b - a)
        d = np.sqrt(((x[mine] - centre) ** 2).sum(axis=1))
        centres.append(centre)
        radii.append(d.max() * (1 + 1e-9) + 1e-6)
        sums.append(total)
        if b - a > LEAF and d.max() > 0:
            p = x[mine[d.argmax()]]
            q = x[mine[((x[mine] - p) ** 2).sum(axis=1).argmax()]]
            along = (x[mine] - (p + q) / 2) @ (q - p)
            by = np.argsort(along, kind="stable")
            cut = int((along < 0).sum())
            if not 0 < cut < b - a:
                cut = (b - a) // 2
            order[a:b] = mine[by]
            lefts[k] = len(starts)
            starts += [a, a + cut]
            ends += [a + cut, b]
            lefts += [-1, -1]
        k += 1
    return {"order": order, "starts": np.array(starts, np.int32), "ends": np.array(ends, np.int32), "lefts": np.array(lefts, np.int32), "centres": np.array(centres), "radii": np.array(radii), "sums": np.array(sums, np.int64)}


def planted(batches):
    """mapInArrow: a row for each tree over a block of vectors."""
    import pyarrow as pa

    schema = pa.schema([(c.split()[0], pa.binary()) for c in TREES.split(", ")])

    def one(ids, nulls, v):
        t = grown(v)
        o = t.pop("order")
        return [ids[o].tobytes(), nulls[o].tobytes(), v[o].tobytes(), *[t[c].tobytes() for c in ("starts", "ends", "lefts", "centres", "radii", "sums")]]

    held: list = []

    def block(rows):
        ids, nulls, v = (np.concatenate(c) for c in zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in one(ids, nulls, v)], schema=schema)

    n = 0
    for batch in batches:
        ids, v = batch.column(0), batch.column(1)
        nulls = np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        v = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1), np.int32)
        at = 0
        while at < len(ids):
            take = min(BLOCK - n, len(ids) - at)
            held.append((ids[at : at + take], nulls[at : at + take], v[at : at + take]))
            n, at = n + take, at + take
            if n == BLOCK:
                yield block(held)
                held, n = [], 0
    if n:
        yield block(held)


def read_tree(row: dict, size: int) -> dict[str, np.ndarray]:
    kinds = {"ids": np.int64, "nulls": np.bool_, "vectors": np.int32, "starts": np.int32, "ends": np.int32, "lefts": np.int32, "centres": np.float64, "radii": np.float64, "sums": np.int64}
    t = {c: np.frombuffer(row[c], kind) for c, kind in kinds.items() if c in row}
    return t | {c: t[c].reshape(-1, size) for c in ("vectors", "centres", "sums") if c in t}


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors x centroids, in 64-bit integers."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    out = np.empty((len(v), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = v.astype(np.int64) - c
        out[:, k] = (d * d).sum(axis=1)
    return out


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rows of several stretches, one after the other."""
    n = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def assigned(tree: dict[str, np.ndarray], centroids: np.ndarray):
    """Walks a tree level by level: yields (nodes, their centroid) of whole balls and (rows, their centroid, None) of leaves."""
    c = centroids.astype(np.float64)
    nodes, able = np.array([0]), np.ones((1, len(c)), bool)
    while len(nodes):
        d = np.sqrt(((tree["centres"][nodes][:, None, :] - c) ** 2).sum(axis=2)) if len(nodes) * len(c) < 4096 else np.stack([np.sqrt(((tree["centres"][nodes] - m) ** 2).sum(axis=1)) for m in c], axis=1)
        d[~able] = np.inf
        best, r = d.min(axis=1), tree["radii"][nodes]
        slack = (best * 1e-9 + 1e-6)[:, None]
        able &= d <= (best + 2 * r)[:, None] + slack  # the others are farther from each point of the ball than the nearest
        sole = able.sum(axis=1) == 1
        if sole.any():
            yield nodes[sole], able[sole].argmax(axis=1), True
        leaf = ~sole & (tree["lefts"][nodes] < 0)
        if leaf.any():
            rows = spans(tree["starts"][nodes[leaf]], tree["ends"][nodes[leaf]])
            yield rows, squared(tree["vectors"][rows], centroids).argmin(axis=1), False
        down = ~sole & ~leaf
        first = tree["lefts"][nodes[down]]
        nodes, able = np.concatenate([first, first + 1]), np.concatenate([able[down], able[down]])


def sums_of(size: int, centroids: np.ndarray):
    """mapInArrow over trees: (cluster, n, sums) of this task for each centroid that gets a vector."""
    import pyarrow as pa

    def run(batches):
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), size), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                t = read_tree(row, size)
                for at, cluster, balls in assigned(t, centroids):
                    np.add.at(n, cluster, (t["ends"] - t["starts"])[at] if balls else 1)
                    np.add.at(total, cluster, t["sums"][at] if balls else t["vectors"][at].astype(np.int64))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(there, pa.int32()), "n": pa.array(n[there]), "sums": pa.array(total[there].tolist(), pa.list_(pa.int64()))})

    return tidy(run)


def labels_of(size: int, centroids: np.ndarray):
    """mapInArrow over trees: (vec_id, cluster, distance) of each vector."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t = read_tree(row, size)
                v = t["vectors"]
                cluster = np.zeros(len(v), np.int32)
                for at, c, balls in assigned(t, centroids):
                    if balls:
                        n = (t["ends"] - t["starts"])[at]
                        cluster[spans(t["starts"][at], t["ends"][at])] = np.repeat(c, n)
                    else:
                        cluster[at] = c
                d = v.astype(np.int64) - centroids[cluster]
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(t["ids"], mask=t["nulls"]), "cluster": pa.array(cluster), "distance": pa.array((d * d).sum(axis=1))})

    return tidy(run)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3, size: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of (vec_id, v), v integers, and the final centroids.

    Centroids start as the k vectors with the smallest sha256 of `seed:vec_id`; where rows share a vec_id, by their
    components; rows without one come last. Fewer than k vectors make fewer centroids. A centroid without vectors stays.
    A vector goes to the centroid with the smaller number where two are equally near. Repeated rows are vectors each. An
    empty table gives no rows and no centroids. k centroids of `size` integers pass through the driver in each round.
    """
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    # one row for each task comes together here, and k rows for each task in a round
    first = vectors.select(name.alias("_h"), "v").orderBy(F.col("_h").asc_nulls_last(), "v").limit(k).collect()
    trees = materialize(vectors.select("vec_id", "v").mapInArrow(tidy(planted), TREES), "ball-trees")
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, size)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    for _ in range(rounds):
        parts = trees.drop("ids", "nulls").mapInArrow(sums_of(size, centroids), "cluster int, n long, sums array<long>")
        each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s"))
        found = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # k * size rows
        centroids = centroids.copy()
        for r in found:
            centroids[r["cluster"], r["at"]] = r["s"] // r["n"]
    out = trees.select("ids", "nulls", "vectors", "starts", "ends", "lefts", "centres", "radii").mapInArrow(labels_of(size, centroids), "vec_id long, cluster int, distance long")
    return out, centroids.tolist()


def op12_clusters(spark, sf_dir: str) -> DataFrame:
    labels, centroids = cluster(whole(table(spark, sf_dir, "embeddings"), "embedding", 64, 1024))
    labels = materialize(labels, "ball-labels")
    totals = labels.groupBy(F.col("cluster").alias("_c")).agg(F.sum("distance").alias("cluster_inertia"))  # k rows
    names = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids)], "_i int, _joined string")
    per = totals.join(names, F.col("_c") == F.col("_i")).crossJoin(totals.agg(F.sum("cluster_inertia").alias("inertia")))
    per = per.select("_c", "cluster_inertia", "inertia", F.sha2("_joined", 256).alias("centroid_sha256"))
    return labels.join(F.broadcast(per), F.col("cluster") == F.col("_c")).drop("_c")


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """SQL of op12: the rounds one after the other."""
    parts = [
        "vectors as materialized (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v, row_number() over () as r from embeddings"
        " where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "cells as (select r, unnest(v) as x, unnest(range(64)) as i from vectors)",
        f"c0 as (select row_number() over (order by h nulls last, v) - 1 as k, v from (select sha256('3:' || vec_id) as h, v from vectors order by h nulls last, v limit {k}))",
    ]
    for n in range(rounds + 1):
        dist = "list_sum(list_transform(list_zip(a.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
        parts.append(f"a{n} as materialized (select r, arg_min(k, (d, k)) as k, min(d) as d from (select a.r, c.k, {dist} as d from vectors a, c{n} c) group by r)")
        if n < rounds:
            floored = "(sum(x)::bigint - ((sum(x)::bigint % count(*)) + count(*)) % count(*)) // count(*)"
            parts.append(f"m{n} as (select k, list(f order by i) as v from (select a.k, b.i, {floored} as f from a{n} a join cells b using (r) group by a.k, b.i) group by k)")
            parts.append(f"c{n + 1} as materialized (select c.k, coalesce(m.v, c.v) as v from c{n} c left join m{n} m on c.k = m.k)")
    return (
        "with " + ",\n".join(parts) + f"\nselect v.vec_id, a.k::int as cluster, a.d as distance, (sum(a.d) over (partition by a.k))::bigint as cluster_inertia,"
        f" (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256 from vectors v join a{rounds} a using (r) join c{rounds} c on a.k = c.k"
    )


ORACLE = oracle()
