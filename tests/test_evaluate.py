"""Bootstrap refits, written annotations, kept statistics, strata."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill import config as C
from strandmill.operators import charts, qc, sampling
from strandmill.plans import evaluate, lifecycle
from strandmill.sources import cache, sinks


@pytest.fixture(scope="module")
def cohort(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    n, m = 200, 6
    g = rng.integers(0, 3, (n, m))
    y = g[:, 2] - 0.7 * g[:, 4] + 0.5 * rng.standard_normal(n)
    path = f"file://{tmp_path_factory.mktemp('calls')}/calls"
    spark.createDataFrame([(i, j, int(g[i, j])) for i in range(n) for j in range(m)], "sample_idx long, variant_idx int, dosage int").write.parquet(path)
    return spark.read.parquet(path), spark.createDataFrame([(i, float(y[i]), "train" if i < 140 else "test") for i in range(n)], "sample_idx long, y double, split string").cache()


def test_refits_differ(cohort):
    calls, samples = cohort
    scores = evaluate.bootstrap_scores(calls, samples, C.Config(C.DataConfig(False, max_samples=200, max_features=6), C.ModelConfig("linear_l2", 1)), 3).collect()
    values = [r.score for r in scores]
    assert [r.refit for r in scores] == [0, 1, 2] and len(set(values)) == 3 and min(values) > 0.5
    got = evaluate.spread(calls.sparkSession.createDataFrame(scores)).first()
    assert abs(got["mean"] - np.mean(values)) < 1e-12 and abs(got["std"] - np.std(values)) < 1e-12


def test_statistics_are_kept_by_files(spark, cohort, tmp_path):
    calls, samples = cohort
    made = []

    def make(own):
        made.append(1)
        return qc.variant_stats(own)

    folder = f"file://{tmp_path}/kept"
    for _ in range(2):
        assert cache.statistics(spark, folder, calls, samples, make).count() == 6
    assert len(made) == 1 and len(cache.files_of(calls)) > 0
    cache.statistics(spark, folder, calls, samples.limit(5), make)
    assert len(made) == 2
    c = C.Config(C.DataConfig(False, max_samples=140, max_features=6), C.ModelConfig("linear_l2", 1))
    a, b = (lifecycle.train(calls, samples, c, folder=f) for f in (None, folder))
    assert sorted(a.stats.collect()) == sorted(b.stats.collect())


def test_annotations_are_written(spark, cohort, tmp_path):
    calls, samples = cohort
    variants = spark.range(6).select(F.col("id").cast("int").alias("variant_idx"), F.lit("1").alias("chr"), F.col("id").alias("pos"))
    stats = qc.variant_stats(calls)
    shap = variants.select("variant_idx", F.lit(0.5).alias("shap_values"), F.lit(0.5).alias("shap_values_abs"))
    values = spark.createDataFrame([(0, "lightgbm", 0.1, 0.2), (0, "catboost", -0.3, 0.3), (2, "catboost", 0.4, 0.4)], "variant_idx int, model_type string, value double, value_abs double")
    edges = spark.createDataFrame([(0, 1, 0.5), (2, 1, 0.5)], "variant_i int, variant_j int, interact_values double")
    sinks.save_annotations(f"file://{tmp_path}/run", variants, stats, shap, values=values, types=["catboost", "lightgbm"], edges=edges)
    tables = cache.plot_inputs(spark, f"file://{tmp_path}/run")
    rows = {r.variant_idx: r for r in tables["annotations"].collect()}
    assert (rows[0].shap_lightgbm, rows[0].shap_abs_catboost, rows[2].shap_catboost, rows[1].shap_catboost) == (0.1, 0.3, 0.4, None) and len(rows) == 6
    assert [(r.variant_i, r.variant_j, r.pos_j) for r in tables["interactions"].collect()] == [(0, 1, 1)]


@pytest.mark.parametrize("size", [0, 7, 333, 5000])
def test_strata(spark, size):
    rows = spark.range(1000).select(F.col("id").alias("sample_idx"), F.when(F.col("id") % 50 == 0, None).otherwise(F.pow(F.col("id"), 2)).cast("double").alias("y"))
    got = sampling.strata_draw(rows, "y", size, 3).toPandas()
    assert len(got) == min(size, 980) and got["sample_idx"].is_unique and got["y"].notna().all()
    if size == 333:
        assert np.ptp(np.histogram(np.sqrt(got["y"]), 10, (0, 1000))[0]) <= 4
    same = rows.withColumn("y", F.lit(2.0))
    assert sampling.strata_draw(same, "y", size, 3).count() == min(size, 1000)


def test_delta_joins(spark):
    l = spark.createDataFrame([(0, "1", 5, -1.0), (1, "1", 5, 2.0), (2, "2", 9, 3.0)], "variant_idx int, chr string, pos long, shap double")
    n = spark.createDataFrame([(7, "1", 5, 4.0), (8, "3", 1, 1.5)], "variant_idx int, chr string, pos long, shap double")
    got = {how: sorted((r.variant_idx, r.delta) for r in charts.delta_rows(l, n, how).collect()) for how in ("inner", "left", "right", "outer")}
    assert got == {"inner": [(0, 3.0), (1, 2.0)], "left": [(0, 3.0), (1, 2.0), (2, -3.0)], "right": [(0, 3.0), (1, 2.0), (8, 1.5)], "outer": [(0, 3.0), (1, 2.0), (2, -3.0), (8, 1.5)]}
    with pytest.raises(ValueError):
        charts.delta_rows(l, n, "cross")
