import numpy as np
import pytest

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.functions import slice

from strandmill import models
from strandmill.operators import density as D
from strandmill.operators import estimators as E
from strandmill.operators import explain as X
from strandmill.sources import plink

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(models.QUERIES))
def test_rows(spark, name):
    assert models.QUERIES[name](spark, DIR).count() > 0


def test_fits():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 5))
    y = x @ [1, 0, -2, 0, 0.5] + 3 + 0.01 * rng.standard_normal(400)
    for model in ("linear", "linear_l2", "bayesian"):
        b, a = E.MODELS[model](x, y)
        assert np.allclose(b, [1, 0, -2, 0, 0.5], atol=0.02) and abs(a - 3) < 0.02
    b, _ = E.MODELS["linear_l1"](x, y)
    assert b[1] == b[3] == 0
    b, _ = E.logistic(x, (y > 3).astype(float))
    assert b[0] > 0 > b[2]


def test_bed_round_trip(spark, tmp_path):
    calls = np.random.default_rng(1).choice([0, 1, 2, -127], (23, 10)).astype(np.int8)
    plink.write_bed(f"{tmp_path}/x.bed", calls)
    rows = plink.read_bed(spark, f"{tmp_path}/x.bed", 10, 7).collect()
    got = np.full((23, 10), -1)
    for r in rows:
        got[r.variant_idx, r.sample_idx] = -127 if r.dosage is None else r.dosage
    assert (got == calls).all()


def expected(leaves, x, known):
    """The path-dependent expectation of one row when only `known` features are told."""
    return sum(v * np.prod([float(low < x[f] <= high) if f in known else s for f, low, high, s in path]) for v, path in leaves)


def test_tree_shap(spark):
    from itertools import combinations
    from math import factorial

    wide = models._wide(spark, DIR).cache()
    model = E.boosted(wide, "features", "y", maxIter=4, maxDepth=3)
    leaves = X.leaves_of(model)
    rows = model.transform(wide).limit(20).collect()
    x = np.array([r.features.toArray() for r in rows])
    phi, both = X.tree_shap(leaves, x), X.tree_shap(leaves, x, pairs=True)
    base = expected(leaves, x[0], set())
    assert np.allclose(phi.sum(axis=1) + base, [r.prediction for r in rows])
    assert np.allclose(both.sum(axis=2), phi) and np.allclose(both, both.transpose(0, 2, 1))
    tree = [leaf for leaf in leaves[:8]]
    used = sorted({f for _, path in tree for f, *_ in path})[:7]
    tree = [(v, path) for v, path in tree if all(f in used for f, *_ in path)]
    got, m = X.tree_shap(tree, x[:3]), len(used)
    for r in range(3):
        for f in used:
            rest = [u for u in used if u != f]
            want = sum(factorial(k) * factorial(m - 1 - k) / factorial(m) * (expected(tree, x[r], {*c, f}) - expected(tree, x[r], set(c))) for k in range(m) for c in combinations(rest, k))
            assert np.isclose(got[r, f], want)


def test_other_shapley_values(spark):
    wide = models._wide(spark, DIR).select("vec_id", "y", array_to_vector(slice(vector_to_array("features"), 1, 6)).alias("features")).cache()
    leaves = X.leaves_of(E.boosted(wide, "features", "y", maxIter=3, maxDepth=3))
    x = np.array([r.features.toArray() for r in wide.limit(60).collect()])
    phi = X.interventional_shap(leaves, x[:8], x)
    assert np.allclose(phi.sum(axis=1), X.leaf_sum(leaves, x[:8]) - X.leaf_sum(leaves, x).mean())
    assert np.allclose(phi, X.kernel_shap(lambda r: X.leaf_sum(leaves, r), x[:8], x), atol=1e-6) and np.abs(phi).max() > 0
    line = X.kernel_shap(lambda r: r @ np.arange(1.0, 5), x[:5, :4], x[:, :4])
    assert np.allclose(line, (x[:5, :4] - x[:, :4].mean(0)) * np.arange(1.0, 5))
    with pytest.raises(ValueError):
        X.kernel_shap(lambda r: r.sum(1), np.zeros((1, 40)), np.zeros((1, 40)))


def test_dbscan_corners(spark):
    schema = "id long, x double, y double"
    assert D.dbscan(spark.createDataFrame([], schema), 1.0, 2).count() == 0
    line = [(i, float(i), 0.0) for i in range(10)] + [(20, 50.0, 0.0), (21, 50.0, 0.0), (22, 90.0, 0.0)]
    got = {r.id: r.cluster for r in D.dbscan(spark.createDataFrame(line, schema), 1.0, 2).collect()}
    assert got == {**dict.fromkeys(range(10), 0), 20: 20, 21: 20, 22: None}


def test_elimination(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 6))
    y = 3 * x[:, 1] - 2 * x[:, 4] + 0.01 * rng.standard_normal(200)
    rows = [(0, i, j, float(x[i, j]), float(y[i])) for i in range(200) for j in range(6)]
    got = {r.variant_idx: r.ranking for r in E.eliminate(spark.createDataFrame(rows, "estimator_idx int, sample_idx long, variant_idx int, x double, y double"), 2).collect()}
    assert got[1] == got[4] == 1 and sorted(got.values()) == [1, 1, 2, 3, 4, 5]


def test_split_by_column(spark):
    """Labels are found among any number of others."""
    from strandmill.operators import sampling

    rows = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("split"))
    got = sampling.split_by_column(rows, "split", ["s3", "s19999"])
    assert {k: v.count() for k, v in got.items()} == {"s3": 1, "s19999": 1}
    with pytest.raises(ValueError, match="s20000"):
        sampling.split_by_column(rows, "split", ["s3", "s20000"])
