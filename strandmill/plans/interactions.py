"""What a trained ensemble's trees say: interactions of variant pairs, and local values of chosen samples by model type.

Only variants that share a path from root to leaf can interact, so pairs get cells as paths have them: no block of rows x
variants x variants exists. A leaf's part depends on which of its path's splits a row follows, so rows are counted by that
pattern first and each pattern is worked out once.
"""

from __future__ import annotations

import json
from math import factorial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import sampling as P
from ..operators.explain import _others
from ..operators.level_trees import worth
from ..operators.packed import pack
from ..operators.storage import cut
from ..sources.views import md5_order
from .lifecycle import Fitted

BOOSTED = ("lightgbm", "xgboost", "catboost")
#: Training rows that are explained at most.
ROWS = 2000


class Member:
    """A boosted member over packed codes: for each tree its leaves (value, path), a path being (place, lowest bin, highest
    bin) for each of its variants, and the bin of each code."""

    def __init__(self, estimator: int, member: int, kind: str, places: np.ndarray, model: dict, x: np.ndarray):
        self.estimator, self.member, self.kind, self.places = estimator, member, kind, places
        self.bins = np.stack([np.searchsorted(c, x[p]) for c, p in zip(model["cuts"], places)]) if len(places) else np.zeros((0, 4), int)
        self.scale = model["rate"] * model.get("sd", 1.0)
        self.leaves: list[tuple[float, dict[int, tuple[int, int]]]] = []
        self.trees: list = []

        def walk(tree, path):
            if not isinstance(tree, list):
                self.leaves.append((tree, path))
                return len(self.leaves) - 1
            j, at, low, high = tree
            a, b = path.get(j, (0, 1 << 30))
            return [j, at, walk(low, path | {j: (a, min(b, at))}), walk(high, path | {j: (max(a, at + 1), b)})]

        self.trees = [walk(t, {}) for t in model["trees"]]
        self.shares: list[dict[int, float]] = []

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The bins (variants x rows) of packed codes."""
        return np.take_along_axis(self.bins, codes[self.places], axis=1)

    def counts(self, bins: np.ndarray) -> np.ndarray:
        """Rows in each leaf."""
        out = np.zeros(len(self.leaves), np.int64)
        for k, (_, path) in enumerate(self.leaves):
            inside = np.ones(bins.shape[1], bool)
            for j, (a, b) in path.items():
                inside &= (bins[j] >= a) & (bins[j] <= b)
            out[k] = inside.sum()
        return out

    def cover(self, counts: np.ndarray) -> None:
        """Shares of the training rows that follow each variant's splits on each leaf's path."""
        self.shares = [dict.fromkeys(path, 1.0) for _, path in self.leaves]

        def below(tree) -> tuple[int, list[int]]:
            if not isinstance(tree, list):
                return int(counts[tree]), [tree]
            (n1, l1), (n2, l2) = below(tree[2]), below(tree[3])
            for n, leaves in ((n1, l1), (n2, l2)):
                for leaf in leaves:
                    self.shares[leaf][tree[0]] *= n / (n1 + n2) if n1 + n2 else 0.0
            return n1 + n2, l1 + l2

        for t in self.trees:
            below(t)

    def patterns(self, k: int, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a leaf: each row's pattern (a bit for each variant of the path that it follows), and patterns as 0 and 1."""
        path = self.leaves[k][1]
        code = np.zeros(bins.shape[1], np.int64)
        for at, (j, (a, b)) in enumerate(path.items()):
            code |= ((bins[j] >= a) & (bins[j] <= b)).astype(np.int64) << at
        there, number = np.unique(code, return_inverse=True)
        return number, (there[:, None] >> np.arange(len(path)) & 1).astype(float)

    def pair_sums(self, bins: np.ndarray) -> dict[tuple[int, int], float]:
        """Sums over the rows of the interaction values (half of a pair's effect) of pairs of places."""
        out: dict[tuple[int, int], float] = {}
        for k, (value, path) in enumerate(self.leaves):
            d = len(path)
            if d < 2:
                continue
            number, on = self.patterns(k, bins)
            times = np.bincount(number, minlength=len(on))
            js, share = list(path), np.array([self.shares[k][j] for j in path])
            w = np.array([factorial(n) * factorial(d - 2 - n) / (2 * factorial(d - 1)) for n in range(d - 1)])
            for a in range(d):
                for b in range(a + 1, d):
                    v = self.scale * value * (on[:, a] - share[a]) * (on[:, b] - share[b]) * (_others(on, share, (a, b)) @ w)
                    key = tuple(sorted((int(self.places[js[a]]), int(self.places[js[b]]))))
                    out[key] = out.get(key, 0.0) + float(v @ times)
        return out

    def local(self, bins: np.ndarray) -> dict[int, np.ndarray]:
        """Shapley values of the rows by place."""
        out: dict[int, np.ndarray] = {}
        for k, (value, path) in enumerate(self.leaves):
            d = len(path)
            if not d:
                continue
            number, on = self.patterns(k, bins)
            share = np.array([self.shares[k][j] for j in path])
            w = np.array([factorial(n) * factorial(d - 1 - n) / factorial(d) for n in range(d)])
            for a, j in enumerate(path):
                v = self.scale * value * (on[:, a] - share[a]) * (_others(on, share, (a,)) @ w)
                place = int(self.places[j])
                out[place] = out.get(place, 0.0) + v[number]
        return out


def boosted_members(fitted: Fitted) -> tuple[list[Member], list[int]]:
    """The kept boosted members and the variants they split on; models are bounded by their settings."""
    rows = [(r["estimator_idx"], r["member"], list(r["variants"]), json.loads(r["model"])) for r in fitted.members.collect()] if "model" in fitted.members.columns else []
    rows = [r for r in rows if r[3]["kind"] in BOOSTED]
    ids = sorted({v for r in rows for v in r[2]})
    x = worth(fitted.stats, ids)
    return [Member(e, k, m["kind"], np.searchsorted(ids, v).astype(int), m, x) for e, k, v, m in sorted(rows, key=lambda r: r[:2])], ids


def matrix(batch) -> np.ndarray:
    return np.stack([np.frombuffer(c, np.uint8) for c in batch.column(batch.schema.get_field_index("codes")).to_pylist()], axis=1)


def covered(members: list[Member], packed: DataFrame) -> None:
    """Counts the training rows in all leaves, in one pass."""

    def run(batches):
        import pyarrow as pa

        total = [np.zeros(len(m.leaves), np.int64) for m in members]
        for batch in batches:
            if batch.num_rows:
                codes = matrix(batch)
                for t, m in zip(total, members):
                    t += m.counts(m.of(codes))
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(members)), pa.int32()), "counts": pa.array([t.tolist() for t in total], pa.list_(pa.int64()))})

    parts = packed.mapInArrow(run, "at int, counts array<long>").select("at", F.posexplode("counts").alias("leaf", "n"))
    got = {(r["at"], r["leaf"]): r["n"] for r in parts.groupBy("at", "leaf").agg(F.sum("n").alias("n")).collect()}  # as many as leaves
    for at, m in enumerate(members):
        m.cover(np.array([got.get((at, k), 0) for k in range(len(m.leaves))]))


def ensemble_interactions(fitted: Fitted, calls: DataFrame, samples: DataFrame, rows: int = ROWS, seed: int = 22) -> DataFrame:
    """(variant_i, variant_j, interact_values), variant_i < variant_j: the mean interaction value over `rows` training samples
    at most (drawn by hash), averaged over an estimator's boosted members and then over the kept estimators that have the
    pair. Empty where no kept member is boosted."""
    spark = calls.sparkSession
    members, ids = boosted_members(fitted)
    train = samples.where("split = 'train' and y is not null").select("sample_idx")
    if not ids:
        return spark.createDataFrame([], "variant_i int, variant_j int, interact_values double")
    packed = cut(pack(calls.join(train, "sample_idx", "left_semi"), ids, everyone=True))
    covered(members, packed)
    few = packed.join(P.bottom_k(train, md5_order(seed, "sample_idx"), "sample_idx", F.lit(rows)), "sample_idx", "left_semi")
    of_each = {e: sum(m.estimator == e for m in members) for e in {m.estimator for m in members}}

    def run(batches):
        import pyarrow as pa

        n, total = 0, [{} for _ in members]
        for batch in batches:
            if batch.num_rows:
                codes = matrix(batch)
                n += codes.shape[1]
                for t, m in zip(total, members):
                    for key, v in m.pair_sums(m.of(codes)).items():
                        t[key] = t.get(key, 0.0) + v
        made = [(m.estimator, ids[i], ids[j], v / of_each[m.estimator]) for t, m in zip(total, members) for (i, j), v in t.items()]
        columns = list(zip(*made)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array([*c, last], t) for c, last, t in zip(columns, (-1, -1, -1, float(n)), (pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["estimator_idx", "variant_i", "variant_j", "s"])

    sums = cut(few.mapInArrow(run, "estimator_idx int, variant_i int, variant_j int, s double").groupBy("estimator_idx", "variant_i", "variant_j").agg(F.sum("s").alias("s")))
    count = sums.where("estimator_idx < 0").select(F.col("s").alias("_n"))
    edges = sums.where("estimator_idx >= 0").join(F.broadcast(count)).select("variant_i", "variant_j", (F.col("s") / F.col("_n")).alias("value"))  # one row
    return A.merged_interactions(edges).where("variant_i < variant_j").withColumnRenamed("value", "interact_values")


def local_by_type(fitted: Fitted, calls: DataFrame, samples: DataFrame, chosen: DataFrame) -> DataFrame:
    """(sample_idx, model_type, variant_idx, phi) of the chosen samples (sample_idx): Shapley values of boosted members, averaged
    over the estimators with members of the type, zeros left out; a chosen sample without calls is an error."""
    members, ids = boosted_members(fitted)
    form = "sample_idx long, model_type string, variant_idx int, phi double"
    lacking = [r[0] for r in chosen.select("sample_idx").distinct().join(calls, "sample_idx", "left_anti").limit(10).collect()]
    if lacking:
        raise ValueError(f"no calls of samples {sorted(lacking)}")
    if not ids:
        return calls.sparkSession.createDataFrame([], form)
    train = samples.where("split = 'train' and y is not null").select("sample_idx")
    covered(members, cut(pack(calls.join(train, "sample_idx", "left_semi"), ids, everyone=True)))
    n_of = {k: len([m for m in members if m.kind == k]) for k in {m.kind for m in members}}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            codes, who = matrix(batch), batch.column(0).to_numpy()
            for kind in sorted(n_of):
                total: dict[int, np.ndarray] = {}
                for m in members:
                    if m.kind == kind:
                        for place, phi in m.local(m.of(codes)).items():
                            total[place] = total.get(place, 0.0) + phi / n_of[kind]
                for place, phi in total.items():
                    at = np.flatnonzero(phi)
                    yield pa.RecordBatch.from_pydict({"sample_idx": pa.array(who[at], pa.int64()), "model_type": pa.array([kind] * len(at), pa.string()), "variant_idx": pa.array(np.full(len(at), ids[place], np.int32)), "phi": pa.array(phi[at], pa.float64())})

    return pack(calls.join(chosen.select("sample_idx").distinct(), "sample_idx", "left_semi"), ids, everyone=True).mapInArrow(run, form)
