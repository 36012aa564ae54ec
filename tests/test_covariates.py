"""Residual strategies of the covariate stage, and labels' scales under trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill import config as C
from strandmill.operators import covar
from strandmill.plans import covariates, lifecycle


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(9)
    n, m = 400, 8
    g, age = rng.integers(0, 3, (n, m)), rng.uniform(30, 70, n)
    value = 100 + 0.5 * age + 3 * np.exp(0.4 * g[:, 2]) + g[:, 5] + 0.3 * rng.standard_normal(n)
    odds = (age - 50) / 10 + 1.5 * (g[:, 2] - 1)
    case = (rng.random(n) < 1 / (1 + np.exp(-odds))).astype(float)
    split = np.where(np.arange(n) < 300, "train", "test")
    calls = spark.createDataFrame([(i, j, int(g[i, j])) for i in range(n) for j in range(m)], "sample_idx long, variant_idx int, dosage int").cache()
    people = spark.createDataFrame([(i, float(value[i]), float(case[i]), float(age[i]), str(split[i])) for i in range(n)], "sample_idx long, value double, case double, age double, split string").cache()
    return calls, people, g, value, case


@pytest.mark.parametrize("kind", ["lightgbm", "random_forest"])
def test_tree_members_predict_on_the_label_scale(cohort, kind):
    calls, people, *_ = cohort
    samples = people.withColumn("y", F.col("value"))
    made = {s: {r.sample_idx: r.pred for r in lifecycle.train(calls, samples, C.Config(C.DataConfig(False, max_samples=300, max_features=8, scale_labels=s), C.ModelConfig(kind, 1))).predict(calls).collect()} for s in (True, False)}
    assert abs(np.mean(list(made[True].values())) - np.mean(list(made[False].values()))) < 0.5
    assert max(abs(made[True][i] - made[False][i]) for i in made[True]) < 1e-6 * 100


@pytest.mark.parametrize("strategy,classes,model", [("yeo-johnson", False, "linear_l2"), ("offset", False, "lightgbm"), ("offset", True, "lightgbm"), ("predictive", False, "catboost")])
def test_strategies(cohort, strategy, classes, model):
    calls, people, g, value, case = cohort
    samples = people.withColumn("y", F.col("case" if classes else "value"))
    config = C.Config(C.DataConfig(classes, max_samples=300, max_features=8), C.ModelConfig(model, 1, class_loss=classes))
    fused = covariates.train(calls, samples, ["age"], config, strategy)
    rows = {r.sample_idx: r for r in fused.predict(calls, samples).collect()}
    truth = case if classes else value
    test = range(300, 400)
    both, alone = (np.corrcoef([rows[i][c] for i in test], truth[300:])[0, 1] for c in ("pred", "covar"))
    if classes:  # labels are noisy; the variant behind them is known
        assert all(0 < r.pred < 1 for r in rows.values())
        assert np.corrcoef([rows[i].geno for i in test], g[300:, 2])[0, 1] > 0.7
        assert all(abs(np.log(r.pred / (1 - r.pred)) - np.log(r.covar / (1 - r.covar)) - r.geno) < 1e-6 for r in rows.values())
    else:
        assert both > alone + 0.02
        assert abs(np.mean([rows[i].pred for i in test]) - truth[300:].mean()) < 0.6
    if strategy == "yeo-johnson":
        assert fused.scale is not None and fused.scale[2] > 0


def test_offsets_need_trees(cohort):
    calls, people, *_ = cohort
    for strategy, classes in (("offset", False), ("yeo-johnson", True)):
        with pytest.raises(ValueError):
            covariates.train(calls, people.withColumn("y", F.col("case")), ["age"], C.Config(C.DataConfig(classes), C.ModelConfig("linear_l2", 1)), strategy)


def test_yeo_johnson_fit(spark):
    """The exponent is that of the largest likelihood, and the inverse undoes the transform."""
    rng = np.random.default_rng(1)
    for true in (-0.7, 0.0, 0.5, 1.0, 2.6):
        z = rng.normal(0, 0.25, 3000)
        lo, hi = (-np.inf, -1 / true - 1e-3) if true < 0 else (1 / (2 - true) + 1e-3, np.inf) if true > 2 else (-np.inf, np.inf)
        z = np.clip(z, lo, hi)
        with np.errstate(invalid="ignore"):
            x = np.where(z >= 0, np.expm1(z) if true == 0 else (z * true + 1) ** (1 / (true or 1)) - 1, 1 - np.exp(-z) if true == 2 else 1 - (1 - (2 - true) * z) ** (1 / (2 - true)))
        df = spark.createDataFrame([(float(v),) for v in x], "x double")

        def likelihood(lam):
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.where(x >= 0, np.log1p(x) if lam == 0 else ((np.maximum(x, 0) + 1) ** lam - 1) / (lam or 1), -np.log1p(-np.minimum(x, 0)) if lam == 2 else -((1 - np.minimum(x, 0)) ** (2 - lam) - 1) / ((2 - lam) or 1))
            return -len(x) / 2 * np.log(t.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

        fitted = covar.fit_yeo_johnson(df, "x")
        assert likelihood(fitted) >= max(likelihood(v) for v in np.linspace(-4, 6, 2001)) - 1e-4
        scale = covar.transformed_scale(df, "x", true)
        assert df.select(F.max(F.abs(covar.inverse_standard(covar.standard_yeo_johnson(F.col("x"), scale), scale) - F.col("x")))).first()[0] < 1e-6
    assert covar.fit_yeo_johnson(spark.createDataFrame([(2.0,)] * 3, "x double"), "x") == 1.0
    out = spark.range(1).select(covar.inverse_yeo_johnson(F.lit(50.0), -0.5).alias("a"), covar.inverse_yeo_johnson(F.lit(-50.0), 3.0).alias("b")).first()
    assert np.isfinite([out.a, out.b]).all()
