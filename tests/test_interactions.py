"""Interactions and local values of a trained ensemble against the dense form of the same values."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill import config as C
from strandmill.operators import explain
from strandmill.plans import interactions, lifecycle
from strandmill.sources import sinks


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(3)
    n, m = 240, 8
    g = rng.integers(0, 3, (n, m))
    y = 1.5 * g[:, 2] * g[:, 5] + g[:, 1] + 0.1 * rng.standard_normal(n)
    calls = spark.createDataFrame([(i, j, None if (i * 7 + j) % 97 == 0 else int(g[i, j])) for i in range(n) for j in range(m)], "sample_idx long, variant_idx int, dosage int").cache()
    samples = spark.createDataFrame([(i, float(y[i]), "train" if i < 200 else "test") for i in range(n)], "sample_idx long, y double, split string").cache()
    config = C.Config(C.DataConfig(False, max_samples=150, max_features=6), C.ModelConfig("lightgbm", 2, ensemble=("catboost", "random_forest")))
    return lifecycle.train(calls, samples, config), calls, samples


def dense(fitted, calls, ids, rows):
    """The leaves of each boosted member over x, with shares counted on the training rows."""
    x = {(r.sample_idx, r.variant_idx): r.x for r in lifecycle.Q.standardize(calls, fitted.stats).collect()}
    out = {}
    for r in fitted.members.collect():
        model = json.loads(r.model)
        if model["kind"] not in interactions.BOOSTED:
            continue
        own = np.array([[x[i, v] for v in r.variants] for i in rows])
        train = np.array([[x[i, v] for v in r.variants] for i in range(200)])
        leaves = []

        def walk(tree, path, mine):
            if not isinstance(tree, list):
                merged = {}
                for j, low, high, share in path:
                    was = merged.get(j, (-np.inf, np.inf, 1.0))
                    merged[j] = (max(was[0], low), min(was[1], high), was[2] * share)
                leaves.append((model["rate"] * tree, [(j, *v) for j, v in merged.items()]))
                return
            j, at, low, high = tree
            t = model["cuts"][j][at]
            down = mine & (train[:, j] <= t)
            share = down.sum() / max(1, mine.sum())
            walk(low, [*path, (j, -np.inf, t, share)], down)
            walk(high, [*path, (j, t, np.inf, 1 - share if mine.any() else 0.0)], mine & ~down)

        for t in model["trees"]:
            walk(t, [], np.ones(200, bool))
        out[r.estimator_idx, r.member] = (model["kind"], list(r.variants), leaves, own)
    return out


def test_interactions(trained, spark):
    fitted, calls, samples = trained
    got = {(r.variant_i, r.variant_j): r.interact_values for r in interactions.ensemble_interactions(fitted, calls, samples).collect()}
    by_estimator = {}
    for (e, _), (_, variants, leaves, own) in dense(fitted, calls, None, range(200)).items():
        pairs = explain.tree_shap(leaves, own, pairs=True).mean(axis=0)
        for a, i in enumerate(variants):
            for b, j in enumerate(variants):
                if i < j and any({a, b} <= {p[0] for p in path} for _, path in leaves):
                    by_estimator.setdefault((i, j), {}).setdefault(e, 0.0)
                    by_estimator[i, j][e] += pairs[a, b] / 2  # two boosted members each
    want = {k: np.mean(list(v.values())) for k, v in by_estimator.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert max(got, key=lambda k: abs(got[k])) == (2, 5)
    edges = interactions.ensemble_interactions(fitted, calls, samples, rows=50)
    named = sinks.named_interactions(edges, spark.range(8).select(F.col("id").cast("int").alias("variant_idx"), F.lit("1").alias("chr"), F.col("id").alias("pos")))
    assert named.where("chr_i = '1' and pos_j > pos_i").count() == named.count() > 0


def test_local_values_by_type(trained, spark):
    fitted, calls, samples = trained
    chosen = spark.createDataFrame([(230,), (7,), (7,)], "sample_idx long")
    got = {(r.sample_idx, r.model_type, r.variant_idx): r.phi for r in interactions.local_by_type(fitted, calls, samples, chosen).collect()}
    want = {}
    for kind, variants, leaves, own in dense(fitted, calls, None, [230, 7]).values():
        phi = explain.tree_shap(leaves, own)
        for s, i in enumerate((230, 7)):
            for a, v in enumerate(variants):
                want[i, kind, v] = want.get((i, kind, v), 0.0) + phi[s, a] / 2  # two estimators
    assert all(abs(got.get(k, 0.0) - v) < 1e-9 for k, v in want.items()) and got.keys() <= want.keys()
    with pytest.raises(ValueError, match="999"):
        interactions.local_by_type(fitted, calls, samples, spark.createDataFrame([(999,)], "sample_idx long"))


def test_linear_ensembles_have_none(trained, spark):
    _, calls, samples = trained
    linear = lifecycle.train(calls, samples, C.Config(C.DataConfig(False, max_samples=150, max_features=6), C.ModelConfig("linear_l2", 1)))
    assert interactions.ensemble_interactions(linear, calls, samples).count() == 0
