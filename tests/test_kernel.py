"""Sampled kernel values against the exact ones and against their sum."""

import numpy as np
import pytest

from strandmill.operators import explain


model = eval("lambda r: r[:, 0] * r[:, 1] + 2 * r[:, 2] - abs(r[:, 3] - r[:, 4]) + (r[:, 5] > 0) * r[:, 6]", {})  # tasks can't import the tests


@pytest.fixture(scope="module")
def rows():
    return np.random.default_rng(4).normal(size=(16, 12))


def frame(spark, x):
    from pyspark.ml.functions import array_to_vector

    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").select("id", array_to_vector("x").alias("features"))


def test_error_on_twelve_features(spark, rows):
    """With 1024 pairs the mean error is below 2 % of the values' spread, the largest below 10 %."""
    background = np.random.default_rng(5).normal(size=(10, 12))
    exact = explain.kernel_shap(model, rows, background)
    got = explain.kernel_values(frame(spark, rows), "id", "features", model, background, 1024, 3).toPandas().pivot(index="id", columns="variant_idx", values="phi").to_numpy()
    spread = exact.std()
    assert np.abs(got - exact).mean() < 0.02 * spread and np.abs(got - exact).max() < 0.1 * spread
    assert np.allclose(got.sum(axis=1), model(rows) - model(background).mean())


def test_blocks_add_up(spark, rows):
    background = np.random.default_rng(6).normal(size=(4, 12))
    one, many = (explain.kernel_values(frame(spark, rows), "id", "features", model, background, 64, b).toPandas().sort_values(["id", "variant_idx"])["phi"].to_numpy() for b in (1, 7))
    assert np.allclose(one, many)


def test_coalitions_come_in_pairs():
    masks, weights = explain.coalitions(9, 300)
    seen = {tuple(m): w for m, w in zip(masks, weights)}
    assert weights.sum() == 600 and all(seen[tuple(~np.array(m))] == w for m, w in seen.items()) and all(0 < sum(m) < 9 for m in seen)


def test_exact_where_all_coalitions_are_drawn(rows):
    background = np.random.default_rng(7).normal(size=(5, 4))
    x = rows[:, :4]
    f = lambda r: r[:, 0] * r[:, 1] + r[:, 2] ** 2 * r[:, 3]
    from math import comb

    masks = np.array([[s >> j & 1 for j in range(4)] for s in range(1, 15)], bool)
    weights = np.array([3 / (comb(4, int(m.sum())) * m.sum() * (4 - m.sum())) for m in masks])
    phi = explain.sampled_kernel(f, x, background, masks, explain.kernel_solver(masks, weights), f(background).mean(), f(x))
    assert np.allclose(phi, explain.kernel_shap(f, x, background)[:, :-1])


def trees(d, n, rng):
    """Leaves of `n` random trees of depth 3 that cut some features twice, and one leaf without a path."""
    out = [(0.7, [])]
    for _ in range(n):
        f, t = rng.integers(0, d, 7), rng.normal(size=7)
        for leaf in range(8):
            path, node = {}, 0
            for bit in (leaf >> 2 & 1, leaf >> 1 & 1, leaf & 1):
                low, high = path.get(f[node], (-np.inf, np.inf))
                path[f[node]] = (max(low, t[node]), high) if bit else (low, min(high, t[node]))
                node = 2 * node + 1 + bit
            out.append((float(rng.normal()), [(int(k), *v, 0.5) for k, v in path.items()]))
    return out


@pytest.mark.parametrize("d", [1, 2, 9, 64])
def test_leaves_give_the_values_of_all_coalitions(spark, d):
    rng = np.random.default_rng(d)
    leaves, x, background = trees(d, 4, rng), rng.normal(size=(30, d)), rng.normal(size=(7, d))
    wide = frame(spark, x)
    want = explain.kernel_values(wide, "id", "features", eval("lambda r: leaf_sum(leaves, r)", {"leaf_sum": explain.leaf_sum, "leaves": leaves}), background, 100, 3)
    got = explain.leaf_kernel_values(wide, "id", "features", leaves, background, 100)
    a, b = (q.toPandas().pivot(index="id", columns="variant_idx", values="phi").to_numpy() for q in (want, got))
    assert a.shape == b.shape == (30, d) and np.allclose(a, b, atol=1e-9) and (d == 1 or np.abs(a).max() > 0.1)


def test_work_on_leaves_does_not_grow_with_coalitions(rows, monkeypatch):
    """No prediction is made for a row under a coalition: those of the ensemble, rows times coalitions times background rows, took the time."""
    leaves = trees(12, 3, np.random.default_rng(1))
    monkeypatch.setattr(explain, "leaf_sum", None)
    masks, weights = explain.coalitions(12, 200)
    phi = explain.leaf_kernel(leaves, rows, rows[:4], masks, explain.kernel_solver(masks, weights))
    monkeypatch.undo()
    assert np.allclose(phi.sum(axis=1), explain.leaf_sum(leaves, rows) - explain.leaf_sum(leaves, rows[:4]).mean())
