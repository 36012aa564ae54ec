import numpy as np
import pytest

from strandmill import config as C
from strandmill.plans import covariates, lifecycle, sweep
from strandmill.sources import sinks


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, (300, 12))
    y = 2.0 * g[:, 2] - 1.5 * g[:, 7] + 0.1 * rng.standard_normal(300)
    split = ["train"] * 180 + ["val"] * 40 + ["agg"] * 40 + ["test"] * 40
    calls = [(i, j, None if (i * 7 + j) % 97 == 0 else int(g[i, j])) for i in range(300) for j in range(12)]
    return (
        spark.createDataFrame(calls, "sample_idx long, variant_idx int, dosage int").cache(),
        spark.createDataFrame([(i, float(y[i]), split[i]) for i in range(300)], "sample_idx long, y double, split string").cache(),
    )


def correlation(fitted, calls, samples):
    rows = fitted.predict(calls).join(samples.where("split = 'test'"), "sample_idx").collect()
    assert len(rows) == 40
    return np.corrcoef([r.pred for r in rows], [r.y for r in rows])[0, 1]


def test_full_patches(spark, cohort):
    calls, samples = cohort
    fitted = lifecycle.train(calls, samples, C.Config(C.DataConfig(False, max_samples=180, max_features=12), C.ModelConfig("linear", 2)))
    assert correlation(fitted, calls, samples) > 0.95
    by_member = lifecycle._scores(lifecycle.Q.standardize(calls, fitted.stats), fitted.members).groupBy("sample_idx").agg(lifecycle.F.avg("pred").alias("m"))
    for r in fitted.predict(calls).join(by_member, "sample_idx").collect():
        assert abs(r.pred - r.m) < 1e-9


def test_weights_and_stop(spark, cohort):
    calls, samples = cohort
    c = C.Config(C.DataConfig(False, max_samples=90, max_features=6), C.ModelConfig("linear_l2", 8, "geq-average", "loss-weighted-average", temp=0.1), C.TrainConfig(2, 2))
    fitted = lifecycle.train(calls, samples, c)
    w = fitted.weights.collect()
    assert 1 <= len(w) <= 8 and abs(sum(r.weight for r in w) - 1) < 1e-9
    assert correlation(fitted, calls, samples) > 0.7


@pytest.mark.parametrize("classes,strategy", [(False, "residualization"), (True, "residualization"), (True, "predictive")])
def test_covariates(spark, cohort, classes, strategy):
    calls, samples = cohort
    F = lifecycle.F
    people = samples.withColumn("age", F.when(F.col("sample_idx") % 50 == 3, None).otherwise((F.col("sample_idx") * 37 % 101) / 10))
    y = F.col("y") + F.coalesce("age", F.lit(5.0))
    people = people.withColumn("y", (y > 6).cast("double") if classes else y)
    config = C.Config(C.DataConfig(classes, max_samples=180, max_features=12), C.ModelConfig("linear", 2))
    fused = covariates.train(calls, people, ["age"], config, strategy)
    rows = fused.predict(calls, people).join(people.where("split = 'test'").select("sample_idx", "y"), "sample_idx").collect()
    assert len(rows) == 40 and all(not classes or 0 <= r.pred <= 1 for r in rows)
    by = {k: np.corrcoef([r[k] for r in rows], [r.y for r in rows])[0, 1] for k in ("covar", "pred")}
    assert by["pred"] > by["covar"] > 0.3
    with pytest.raises(ValueError):
        covariates.train(calls, people, ["age"], config, "magic")


def test_sinks_and_sweep(spark, cohort, tmp_path):
    calls, samples = cohort
    F = lifecycle.F
    c = C.Config(C.DataConfig(False, max_samples=180, max_features=12), C.ModelConfig("linear", 1))
    fitted = lifecycle.train(calls, samples, c)
    sinks.save_model(fitted, f"file://{tmp_path}/model")
    want = {r.sample_idx: r.pred for r in fitted.predict(calls).collect()}
    got = sinks.load_model(spark, f"file://{tmp_path}/model").predict(calls)
    assert {r.sample_idx: pytest.approx(r.pred) for r in got.collect()} == want
    sinks.save_run(got, f"file://{tmp_path}/run", seed=22, trait="y")
    assert spark.read.parquet(f"file://{tmp_path}/run/predictions").count() == 300 and spark.read.json(f"file://{tmp_path}/run/metadata").first().seed == 22
    variants = spark.range(13).select(F.col("id").cast("int").alias("variant_idx"), F.lit("1").alias("chr"), F.col("id").alias("pos"))
    shap = variants.where("variant_idx < 3").select("variant_idx", F.lit(0.5).alias("shap_values"), F.lit(0.5).alias("shap_values_abs"))
    rows = {r.variant_idx: r for r in sinks.annotations(variants, fitted.stats, shap, fitted.coefs).collect()}
    assert len(rows) == 13 and rows[2].effect_weight > 1 and rows[2].effect_type == "additive" and rows[12].effect_weight is None and rows[5].shap_values is None
    edges = spark.createDataFrame([(0, 1, 0.5), (2, 1, 0.5), (1, 20, 0.1)], "variant_i int, variant_j int, interact_values double")
    assert sorted((r.variant_i, r.pos_j) for r in sinks.named_interactions(edges, variants).collect()) == [(0, 1), (1, None)]
    trials = sweep.sweep(calls, samples, c, {"model_name": ["linear", "linear_l1"], "max_features": [3, 12]}, 2).collect()
    assert len(trials) == 2 and all(0 <= t.score <= 1 for t in trials) and len({t.settings for t in trials}) == 2
    assert sweep.settings({"a": [1, 2], "b": [3]}, 9, 1) in ([{"a": 1, "b": 3}, {"a": 2, "b": 3}], [{"a": 2, "b": 3}, {"a": 1, "b": 3}])


def test_config():
    text = "DataConfig:\n  classification: true\n---\nModelConfig:\n  model_name: logistic\n  n_estimators: 4\n"
    c = C.load(text, seed=5, n_estimators=6)
    assert c.scorer == "rocauc" and c.model.n_estimators == 6 and c.train.seed == 5 and c.model.bar(True) == 0.5
    for bad in ("DataConfig:\n  classification: true\n  maf_treshold: 1\n", "DataConfig:\n  classification: true\n---\nModelConfig:\n  model_name: magic\n"):
        with pytest.raises((TypeError, ValueError)):
            C.load(bad)
    with pytest.raises(TypeError):
        C.load(text, patiense=1)
    with pytest.raises(ValueError):
        C.Config(C.DataConfig(False), train=C.TrainConfig(scorer="rocauc"))


@pytest.mark.parametrize("kind", ["lightgbm", "xgboost", "catboost", "random_forest"])
def test_trees(spark, cohort, kind, tmp_path):
    """Tree members learn, alone and together on one patch, and come back from disk."""
    calls, samples = cohort
    c = C.Config(C.DataConfig(False, max_samples=180, max_features=12), C.ModelConfig(kind, 2, ensemble=("xgboost",)))
    fitted = lifecycle.train(calls, samples, c)
    assert correlation(fitted, calls, samples) > (0.9 if kind != "random_forest" else 0.8)
    assert fitted.members.count() == 4
    sinks.save_model(fitted, f"file://{tmp_path}/m")
    again = sinks.load_model(spark, f"file://{tmp_path}/m").predict(calls).collect()
    assert {r.sample_idx: round(r.pred, 9) for r in again} == {r.sample_idx: round(r.pred, 9) for r in fitted.predict(calls).collect()}


def test_tree_fits():
    """Boosting on weights, offsets and a stop, against what they mean."""
    from strandmill.operators import boosting

    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (400, 5)).astype(float)
    y = x[:, 0] * x[:, 1] + 0.1 * rng.standard_normal(400)
    for kind in boosting.SETTINGS:
        got = boosting.read_trees(boosting.fit_trees(x, y, kind), x)
        assert np.corrcoef(got, y)[0, 1] > 0.9, kind
    doubled = boosting.fit_trees(np.vstack([x, x[:100]]), np.r_[y, y[:100]], "lightgbm")
    weighted = boosting.fit_trees(x, y, "lightgbm", weight=np.r_[np.full(100, 2.0), np.ones(300)])
    assert abs(boosting.read_trees(doubled, x) - boosting.read_trees(weighted, x)).mean() < 0.05
    offset = 3.0 * x[:, 2]
    model = boosting.fit_trees(x, y + offset, "xgboost", offset=offset)
    assert np.corrcoef(boosting.read_trees(model, x), y)[0, 1] > 0.9
    noise = rng.standard_normal(400)
    stopped = boosting.fit_trees(x, noise, "xgboost", check=np.arange(400) % 4 == 0)
    assert len(stopped["trees"]) < 20
    labels = (y > y.mean()).astype(float)
    p = boosting.read_trees(boosting.fit_trees(x, labels, "catboost", classes=True), x)
    assert ((p > 0.5) == labels).mean() > 0.9 and 0 <= p.min() <= p.max() <= 1


def test_settings_of_training(spark, cohort):
    """Selection, label scaling, outliers, rank-mean, draws and class losses."""
    calls, samples = cohort
    picked = lifecycle.train(calls, samples, C.Config(C.DataConfig(False, max_samples=180, max_features=12), C.ModelConfig("linear", 2, k_best=2)))
    assert {r.variant_idx for r in picked.coefs.collect()} == {-1, 2, 7}
    plain = C.Config(C.DataConfig(False, max_samples=180, max_features=12), C.ModelConfig("linear", 1))
    scaled = C.override(plain, scale_labels=True)
    a, b = ({r.sample_idx: r.pred for r in lifecycle.train(calls, samples, c).predict(calls).collect()} for c in (plain, scaled))
    assert max(abs(a[k] - b[k]) for k in a) < 1e-5
    ranked = lifecycle.train(calls, samples, C.override(plain, agg_strat="rank-mean", n_estimators=3))
    assert correlation(ranked, calls, samples) > 0.9 and {r.how for r in ranked.weights.collect()} == {"rank-mean"}
    assert correlation(lifecycle.train(calls, samples, C.override(plain, outlier_threshold=3.0)), calls, samples) > 0.9
    classes = samples.withColumn("y", (lifecycle.F.col("y") > 1).cast("double")).withColumn("population", lifecycle.F.pmod("sample_idx", lifecycle.F.lit(2)).cast("string"))
    for draw in ("stratified", "balanced", "per-population"):
        c = C.Config(C.DataConfig(True, max_samples=100, max_features=12, draw=draw, fixed_draw=draw == "stratified"), C.ModelConfig("linear_l1", 2, class_loss=True, ensemble=("sgd_l2",)))
        assert correlation(lifecycle.train(calls, classes, c), calls, classes) > 0.6, draw
    with pytest.raises(ValueError, match="draw"):
        C.DataConfig(True, draw="any")
    with pytest.raises(ValueError, match="ensemble"):
        C.ModelConfig("lightgbm", ensemble=("linear",))


def test_sample_plans(spark):
    from strandmill.operators import sampling

    rows = spark.createDataFrame([(i, float(i % 4 == 0), f"p{i % 3}") for i in range(60)], "sample_idx long, y double, population string")
    of = {r.sample_idx: (r.y, r.population) for r in rows.collect()}

    def plan(**settings):
        out = {}
        for r in sampling.sample_plan(rows, 3, settings.pop("size", 20), 5, **settings).collect():
            out.setdefault(r.estimator_idx, []).append(r.sample_idx)
        return out

    for got in plan(how="stratified").values():
        assert sum(of[i][0] for i in got) == 10 and len(set(got)) == len(got) == 20
    for got in plan(how="balanced", controls=2, size=40).values():
        assert sum(of[i][0] for i in got) == 15 and len(got) == 40
    for got in plan(how="per-population").values():
        assert [sum(of[i][1] == f"p{k}" for i in got) for k in range(3)] == [6, 6, 6]
    fixed = [sorted(x) for x in plan(how="random", fixed=True).values()]
    assert fixed[0] == fixed[1] == fixed[2] and len(fixed[0]) == 20
    assert len({tuple(sorted(x)) for x in plan(how="random").values()}) == 3
