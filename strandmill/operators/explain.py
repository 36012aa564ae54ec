"""Shapley values of tree ensembles, path dependent.

A leaf pays its value times a product over the features on its path: 1 or 0 (does the row follow the feature's splits)
for a known feature, the share of training rows that follow them for an unknown one. The Shapley value of a product game
has a closed form in the coefficients of a polynomial, so each leaf is a few numpy operations over all rows.
"""

from __future__ import annotations

from math import comb, factorial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaves_of(model) -> list[tuple]:
    """[(value, [(feature, low, high, share), ...])] of a fitted MLlib ensemble: a leaf needs low < x <= high. Trees are
    read on the driver; their size is bounded by their number and depth."""
    out = []
    weights = list(model.treeWeights)

    def walk(node, path, weight):
        if node.subtreeDepth() == 0:
            merged: dict = {}
            for f, low, high, share in path:
                was = merged.get(f, (-np.inf, np.inf, 1.0))
                merged[f] = (max(was[0], low), min(was[1], high), was[2] * share)
            out.append((weight * node.prediction(), [(f, *m) for f, m in merged.items()]))
            return
        f, t, n = node.split().featureIndex(), node.split().threshold(), node.impurityStats().count()
        left, right = node.leftChild(), node.rightChild()
        walk(left, [*path, (f, -np.inf, t, left.impurityStats().count() / n)], weight)
        walk(right, [*path, (f, t, np.inf, right.impurityStats().count() / n)], weight)

    for tree, weight in zip(model.trees, weights):
        walk(tree._call_java("rootNode"), [], weight)
    return out


def _others(on: np.ndarray, share: np.ndarray, without: tuple) -> np.ndarray:
    """Coefficients, rows x degree, of the product over the other features of (share + on t)."""
    c = np.ones((len(on), 1))
    for j in range(on.shape[1]):
        if j not in without:
            c = np.pad(c * share[j], ((0, 0), (0, 1))) + np.pad(c * on[:, [j]], ((0, 0), (1, 0)))
    return c


def tree_shap(leaves: list[tuple], x: np.ndarray, pairs: bool = False) -> np.ndarray:
    """rows x features, or with pairs rows x features x features: interaction values off the diagonal (half of a pair's
    effect on each side), main effects on it; both sum to the prediction less the expected one."""
    n, m = x.shape
    phi, both = np.zeros((n, m)), np.zeros((n, m, m) if pairs else (0, 0, 0))
    for value, path in leaves:
        d = len(path)
        if d == 0:
            continue
        on = np.column_stack([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in path]).astype(float)
        share = np.array([s for *_, s in path])
        w = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
        w2 = np.array([factorial(k) * factorial(d - 2 - k) / (2 * factorial(d - 1)) for k in range(d - 1)])
        for i in range(d):
            phi[:, path[i][0]] += value * (on[:, i] - share[i]) * (_others(on, share, (i,)) @ w)
            for j in range(i + 1, d) if pairs else ():
                v = value * (on[:, i] - share[i]) * (on[:, j] - share[j]) * (_others(on, share, (i, j)) @ w2)
                both[:, path[i][0], path[j][0]] += v
                both[:, path[j][0], path[i][0]] += v
    if not pairs:
        return phi
    for f in range(m):
        both[:, f, f] = phi[:, f] - both[:, f].sum(axis=1)
    return both


def local_shap(wide: DataFrame, key: str, features: str, model) -> DataFrame:
    """(key, variant_idx, phi): the non-zero Shapley values of every row. The leaves, bounded by the model's settings, go
    to the executors with the function."""
    leaves = leaves_of(model)
    return local_values(wide, key, features, lambda x: tree_shap(leaves, x))


def pair_sums(leaves: list[tuple], x: np.ndarray) -> dict[tuple[int, int], float]:
    """Sums over the rows of the interaction values of feature pairs that share a path, (i, j) with i < j. Rows that follow the
    same of a path's splits have the same value, so each pattern is worked out once; other pairs have no cell."""
    out: dict[tuple[int, int], float] = {}
    for value, path in leaves:
        d = len(path)
        if d < 2:
            continue
        on = np.column_stack([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in path])
        there, times = np.unique(on @ (1 << np.arange(d)), return_counts=True)
        on, share = (there[:, None] >> np.arange(d) & 1).astype(float), np.array([s for *_, s in path])
        w = np.array([factorial(k) * factorial(d - 2 - k) / (2 * factorial(d - 1)) for k in range(d - 1)])
        for i in range(d):
            for j in range(i + 1, d):
                v = value * (on[:, i] - share[i]) * (on[:, j] - share[j]) * (_others(on, share, (i, j)) @ w)
                key = (min(path[i][0], path[j][0]), max(path[i][0], path[j][0]))
                out[key] = out.get(key, 0.0) + float(v @ times)
    return out


def interactions(wide: DataFrame, features: str, model) -> DataFrame:
    """(variant_i, variant_j, interact_values) with i < j: mean interaction values over all rows of pairs that share a path, zero
    ones left out. Each batch sends one partial sum for a pair."""
    from pyspark.ml.functions import vector_to_array

    leaves = leaves_of(model)

    def run(frames):
        import pandas as pd

        for f in frames:
            if len(f):
                v = {k: s for k, s in pair_sums(leaves, np.stack(f["_x"].to_numpy())).items() if s}
                i, j = zip(*v) if v else ((), ())
                yield pd.DataFrame({"variant_i": [-1, *i], "variant_j": [-1, *j], "s": [0.0, *v.values()], "n": [len(f)] + [0] * len(v)})

    sums = wide.select(vector_to_array(features).alias("_x")).mapInPandas(run, "variant_i int, variant_j int, s double, n long")
    sums = sums.groupBy("variant_i", "variant_j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    rows = sums.where("variant_i = -1").select(F.col("n").alias("_n"))
    return sums.where("variant_i >= 0").join(F.broadcast(rows)).select("variant_i", "variant_j", (F.col("s") / F.col("_n")).alias("interact_values"))  # one row


def interventional_shap(leaves: list[tuple], x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """rows x features: Shapley values when unknown features take the background rows' values, averaged over those. A leaf
    needs one pass for each different pattern of its path's splits among the background rows, at most 2^depth."""
    phi = np.zeros(x.shape)
    for value, path in leaves:
        d = len(path)
        if d == 0:
            continue
        follows = lambda rows: np.column_stack([(rows[:, f] > low) & (rows[:, f] <= high) for f, low, high, _ in path]).astype(float)  # noqa: B023, E731
        on = follows(x)
        patterns, counts = np.unique(follows(background), axis=0, return_counts=True)
        w = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
        for pattern, c in zip(patterns, counts / len(background)):
            for i in range(d):
                phi[:, path[i][0]] += value * c * (on[:, i] - pattern[i]) * (_others(on, pattern, (i,)) @ w)
    return phi


def kernel_shap(predict, x: np.ndarray, background: np.ndarray, most_features: int = 12) -> np.ndarray:
    """rows x features: Shapley values of any function of rows, by the weighted regression over all coalitions; for few
    features only, since there are 2^features of them."""
    n, d = x.shape
    if d > most_features:
        raise ValueError(f"all coalitions of {d} features are too many")
    empty, full = predict(background).mean(), predict(x)
    if d == 1:
        return (full - empty)[:, None]
    masks = np.array([[s >> j & 1 for j in range(d)] for s in range(1, 2**d - 1)], dtype=bool)
    size = masks.sum(axis=1)
    weight = np.sqrt([(d - 1) / (comb(d, int(s)) * s * (d - s)) for s in size])
    value = np.array([[predict(np.where(m, row, background)).mean() for row in x] for m in masks])
    design = masks[:, :-1].astype(float) - masks[:, -1:]
    target = value - empty - masks[:, -1:] * (full - empty)
    b = np.linalg.lstsq(design * weight[:, None], target * weight[:, None], rcond=None)[0].T
    return np.column_stack([b, full - empty - b.sum(axis=1)])


def coalitions(d: int, pairs: int, seed: int = 22) -> tuple[np.ndarray, np.ndarray]:
    """(masks, weights) of coalitions of d features drawn by the Shapley kernel, each with its complement, equal ones once with
    their weights added up. Sizes are drawn in proportion to the kernel's weight of all coalitions of the size."""
    rng, size = np.random.default_rng(seed), np.arange(1, d)
    sizes = rng.choice(size, pairs, p=(1 / (size * (d - size))) / (1 / (size * (d - size))).sum())
    order = rng.random((pairs, d)).argsort(axis=1).argsort(axis=1)
    drawn = order < sizes[:, None]
    return np.unique(np.concatenate([drawn, ~drawn]), axis=0, return_counts=True)


def sampled_kernel(predict, x: np.ndarray, background: np.ndarray, masks: np.ndarray, solver: np.ndarray, empty: float, full: np.ndarray) -> np.ndarray:
    """rows x (features - 1): what these coalitions add to the solution of the normal equations. `solver` maps a coalition's
    value to the coefficients (one column for each mask), so parts of the coalitions add up."""
    def filled(m):  # each row with each background row, some hundred rows at once
        return np.concatenate([predict(np.where(m, part[:, None, :], background).reshape(-1, x.shape[1])).reshape(len(part), -1).mean(axis=1) for part in np.array_split(x, -(-len(x) // 256))])

    value = np.array([filled(m) for m in masks]).reshape(len(masks), len(x))
    return (solver @ (value - empty - masks[:, -1:] * (full - empty))).T


def kernel_solver(masks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(features - 1) x masks: the weighted least-squares solution as a linear map of the coalitions' values, the last
    feature's value being what is left of the total."""
    design = masks[:, :-1].astype(float) - masks[:, -1:]
    normal = design.T @ (design * weights[:, None])
    return np.linalg.pinv(normal, hermitian=True) @ (design * weights[:, None]).T


def kernel_values(wide: DataFrame, key: str, features: str, predict, background: np.ndarray, pairs: int = 1024, blocks: int = 8, seed: int = 22) -> DataFrame:
    """(key, variant_idx, phi) of every row and every feature, by coalitions drawn from the Shapley kernel for any number of
    features. Each row meets each block of coalitions in a task of its own and the blocks' parts of the solution are summed;
    background and coalitions, whose number is a parameter, go to the tasks."""
    from pyspark.ml.functions import vector_to_array

    d, spark = background.shape[1], wide.sparkSession
    kind = wide.schema[key].dataType.simpleString()
    empty = float(predict(background).mean())
    if d == 1:
        return local_values(wide, key, features, lambda x: (predict(x) - empty)[:, None])
    masks, weights = coalitions(d, pairs, seed)
    parts = np.array_split(np.arange(len(masks)), blocks)
    solver = kernel_solver(masks, weights)

    def run(frames):
        import pandas as pd

        for f in frames:
            for block, own in f.groupby("_block"):
                x, at = np.stack(own["_x"].to_numpy()), parts[block]
                full = predict(x)
                phi = sampled_kernel(predict, x, background, masks[at], solver[:, at], empty, full)
                rest = (full - empty if block == 0 else 0.0) - phi.sum(axis=1)
                phi = np.column_stack([phi, rest])
                yield pd.DataFrame({key: np.repeat(own[key].to_numpy(), d), "variant_idx": np.tile(np.arange(d, dtype=np.int32), len(x)), "part": phi.ravel()})

    n = F.broadcast(spark.range(blocks).select(F.col("id").cast("int").alias("_block")))  # a row for each block
    rows = wide.select(key, vector_to_array(features).alias("_x")).crossJoin(n).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key, "_block")
    return rows.mapInPandas(run, f"{key} {kind}, variant_idx int, part double").groupBy(key, "variant_idx").agg(F.sum("part").alias("phi"))


def leaf_kernel(leaves: list[tuple], x: np.ndarray, background: np.ndarray, masks: np.ndarray, solver: np.ndarray) -> np.ndarray:
    """rows x features: what sampled_kernel gives of the leaves' sum over all coalitions, without a prediction for each row,
    coalition and background row. A leaf's part of a coalition's value depends on which of its path's splits the row follows
    and which of its path's features the coalition has, and the solution is linear in the values: so each pattern of a path's
    splits that occurs is solved once, and a row adds up its patterns' solutions."""
    phi = np.zeros(x.shape)
    for value, path in leaves:
        if not path:
            continue
        follows = lambda rows: np.column_stack([(rows[:, f] > low) & (rows[:, f] <= high) for f, low, high, _ in path])  # noqa: B023, E731
        patterns, at = np.unique(follows(x), axis=0, return_inverse=True)
        own, there = masks[:, [f for f, *_ in path]], follows(background)
        known, times = np.unique(own, axis=0, return_inverse=True)  # path features that coalitions have
        rest = (known[:, None, :] | there).all(axis=2).mean(axis=1)  # background rows that follow the others
        paid = value * ((~known[:, None, :] | patterns).all(axis=2) * rest[:, None])[times.ravel()]
        empty, full = value * there.all(axis=1).mean(), value * patterns.all(axis=1)
        solved = (solver @ (paid - empty - masks[:, -1:] * (full - empty))).T
        phi += np.column_stack([solved, full - empty - solved.sum(axis=1)])[at.ravel()]
    return phi


def leaf_kernel_values(wide: DataFrame, key: str, features: str, leaves: list[tuple], background: np.ndarray, pairs: int = 1024, seed: int = 22) -> DataFrame:
    """kernel_values of an ensemble's leaves: the same coalitions, background and regression, a row's work growing with the
    leaves and no more with coalitions times background rows. No row meets another."""
    d, spark = background.shape[1], wide.sparkSession
    spread = wide.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    if d == 1:
        empty = float(leaf_sum(leaves, background).mean())
        return local_values(spread, key, features, lambda x: (leaf_sum(leaves, x) - empty)[:, None], True)
    masks, weights = coalitions(d, pairs, seed)
    solver = kernel_solver(masks, weights)
    return local_values(spread, key, features, lambda x: leaf_kernel(leaves, x, background, masks, solver), True)


def leaf_sum(leaves: list[tuple], x: np.ndarray) -> np.ndarray:
    """Predictions of an ensemble from its leaves."""
    out = np.zeros(len(x))
    for value, path in leaves:
        out += value * np.prod([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in path], axis=0, initial=1.0)
    return out


def background_rows(wide: DataFrame, features: str, key: str, size: int = 500, seed: int = 22) -> np.ndarray:
    """A bounded draw of rows in hash order, for the functions that need a background on every executor."""
    from pyspark.ml.functions import vector_to_array

    order = F.md5(F.concat_ws("_", F.col(key).cast("string"), F.lit(str(seed))))
    got = wide.select(vector_to_array(features).alias("_x"), order.alias("_o"), key).orderBy("_o", key).limit(size).collect()
    return np.array([r["_x"] for r in got], dtype=float)


def local_values(wide: DataFrame, key: str, features: str, explain, zeros: bool = False) -> DataFrame:
    """(key, variant_idx, phi) of every row, zeros left out unless asked for; `explain` maps rows x features to values of the
    same shape."""
    from pyspark.ml.functions import vector_to_array

    kind = wide.schema[key].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for f in frames:
            if len(f):
                phi = explain(np.stack(f["_x"].to_numpy()))
                i, j = np.nonzero(np.ones_like(phi) if zeros else phi)
                yield pd.DataFrame({key: f[key].to_numpy()[i], "variant_idx": j.astype(np.int32), "phi": phi[i, j]})

    return wide.select(key, vector_to_array(features).alias("_x")).mapInPandas(run, f"{key} {kind}, variant_idx int, phi double")
