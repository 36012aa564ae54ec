"""Selection, reports, caches and simulation: what SQL doesn't show, such as errors, shapes and kept files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill import catalog, models
from strandmill.operators import estimators, reports, selection, simulate
from strandmill.sources import cache, plink

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, i % 2, float(i), "train" if i < 15 else "test") for i in range(20)], "sample_idx long, label int, y double, split string").cache()


def test_ids_and_slices(spark, rows):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "sample_idx long")
    assert {r.sample_idx for r in selection.by_label(rows, ids(3, 3, 9), "sample_idx").collect()} == {3, 9}
    with pytest.raises(ValueError, match="77"):
        selection.by_label(rows, ids(3, 77), "sample_idx")
    with pytest.raises(ValueError, match="two lists"):
        selection.split_by_lists(rows, {"train": ids(1, 2), "val": ids(2)}, "sample_idx")
    high = rows.withColumn("sample_idx", F.col("sample_idx") * 10 + 5)
    assert [r.sample_idx for r in selection.by_position(high, "sample_idx", 2, 9, 3).orderBy("sample_idx").collect()] == [25, 55, 85]
    assert sorted(r.position for r in selection.numbered(high, ["sample_idx"]).collect()) == list(range(20))
    assert selection.by_position(rows.limit(0), "sample_idx").count() == 0
    with pytest.raises(ValueError):
        selection.by_position(rows, "sample_idx", -1)


def test_draws(rows):
    got = selection.draw_with_classes(rows, "label", 3, 1)
    assert got.count() == 3 and {r.label for r in got.collect()} == {0, 1}
    with pytest.raises(ValueError, match="classes"):
        selection.draw_with_classes(rows, "label", 1, 1)
    fixed = selection.sample_draws(rows, 3, 5, 2, True).collect()
    by = {e: {r.sample_idx for r in fixed if r.estimator_idx == e} for e in range(3)}
    assert by[0] == by[1] == by[2] and len(by[0]) == 5
    fresh = selection.sample_draws(rows, 3, 5, 2, False).collect()
    assert len({frozenset(r.sample_idx for r in fresh if r.estimator_idx == e) for e in range(3)}) > 1
    assert {r.split for r in selection.simulation_split(rows, 0.3, 1).collect()} == {"train", "val", "test"}


def test_label_scaling(rows):
    scale = selection.label_scale(rows, "y")
    z = [r.y for r in selection.standardised_label(rows, "y", scale).where("split = 'train'").collect()]
    assert abs(np.mean(z)) < 1e-12 and abs(np.std(z) - 1) < 1e-12
    flat = rows.withColumn("y", F.lit(2.0))
    assert selection.label_scale(flat, "y").first()["sd"] == 1.0


def test_reports(spark, rows):
    preds = spark.createDataFrame([(0, 1, 0.5), (1, 1, 0.7)], "estimator_idx int, sample_idx long, pred double")
    with pytest.raises(ValueError, match="2 estimators"):
        reports.only_estimator(preds)
    v = spark.createDataFrame([("chrX", 5, 1), ("2", 9, 2), ("chr2", 1, 3), ("Un", 0, 4), ("10", 0, 5)], "chr string, pos long, variant_idx int")
    assert [r.variant_idx for r in reports.genomic_order(v).collect()] == [3, 2, 5, 1, 4]
    peaks = spark.createDataFrame([(1, 1, f"rs{i}", float(i), i) for i in range(5)] + [(1, 2, "rs9", 1.0, 9)], "chr_order int, peak long, snp string, shap double, variant_idx int")
    got = {r.peak: (r.label, r.more) for r in reports.peak_labels(peaks, peaks).collect()}
    assert got == {1: ("rs4,rs3,rs2", 2), 2: ("rs9", 0)}
    a = reports.content_hash(rows, rows.columns).first()
    assert a == reports.content_hash(rows.repartition(3), rows.columns).first() != reports.content_hash(rows.where("sample_idx > 0"), rows.columns).first()
    null = spark.createDataFrame([(None,), ("",)], "x string")
    assert reports.content_hash(null.where("x is null"), ["x"]).first() != reports.content_hash(null.where("x = ''"), ["x"]).first()


def test_caches(spark, rows, tmp_path, monkeypatch):
    folder, made = f"file://{tmp_path}", []

    def make():
        made.append(1)
        return rows

    key = cache.key_of({"a": 1}, rows)
    for _ in range(2):
        assert cache.kept(spark, folder, "rows", key, make).count() == 20
    assert len(made) == 1 and key != cache.key_of({"a": 2}, rows) != cache.key_of({"a": 2}, rows.limit(3))
    calls = spark.createDataFrame([(i, v, (i + v) % 3) for i in range(20) for v in range(3)], "sample_idx long, variant_idx int, dosage int")
    from strandmill.operators.qc import variant_stats

    assert cache.statistics(spark, folder, calls, rows, variant_stats).count() == 3 and cache.preload(calls).count() == 60
    rows.write.parquet(f"{folder}/annotations")
    assert set(cache.plot_inputs(spark, folder)) == {"annotations"}
    for name, variable in cache.PATHS.items():
        monkeypatch.setenv(variable, f"/data/{name}")
    assert cache.paths({"bed": "/x"}) == {"fam": "/data/fam", "bed": "/x", "bim": "/data/bim", "master": "/data/master"}
    monkeypatch.setenv("FAM_PATH", "b'/data'")
    with pytest.raises(ValueError, match="bytes"):
        cache.paths()
    monkeypatch.delenv("FAM_PATH")
    with pytest.raises(ValueError, match="FAM_PATH"):
        cache.paths()
    got = cache.metrics(spark.createDataFrame([(e, e / 10) for e in range(5)], "estimator_idx int, score double"), "r", 2).orderBy("batch").collect()
    assert [(r.batch, r.n_estimators, r.best) for r in got] == [(0, 2, 0.1), (1, 2, 0.3), (2, 1, 0.4)]


def test_plink_files(spark, tmp_path):
    """Sample and variant tables, calls back from the packed file, and its faults."""
    dosage, cov, y = simulate.demo(13, 40, 3)
    plink.write_bed(f"{tmp_path}/d.bed", dosage)
    plink.write_fam(f"{tmp_path}/d.fam", 13)
    plink.write_bim(f"{tmp_path}/d.bim", [str(1 + i % 25) for i in range(40)])
    plink.write_master(f"{tmp_path}/d.phe", {"age": cov[:, 0], "sex": cov[:, 1], "y": y})
    fam, bim = plink.read_fam(spark, f"file://{tmp_path}/d.fam").collect(), plink.read_bim(spark, f"file://{tmp_path}/d.bim").collect()
    assert [(r.sample_idx, r.iid) for r in sorted(fam, key=lambda r: r.sample_idx)] == [(i, str(1000 + i)) for i in range(13)]
    assert {r.chrom for r in bim} == {str(i) for i in range(1, 23)} and all(r.rsID == f"chr{r.chrom}:{r.pos}:{r.a0}:{r.a1}" for r in bim)
    master = plink.read_master(spark, f"file://{tmp_path}/d.phe", ["age", "y"]).collect()
    assert len(master) == 13 and {r.IID for r in master} == {str(1000 + i) for i in range(13)}
    got = np.full((40, 13), 9)
    for r in plink.read_bed(spark, f"{tmp_path}/d.bed", 13, 7).collect():
        got[r.variant_idx, r.sample_idx] = -127 if r.dosage is None else r.dosage
    assert np.array_equal(got, dosage)
    few = plink.read_bed(spark, f"{tmp_path}/d.bed", 13, 7, samples=[4, 2, 4]).collect()
    assert len(few) == 40 * 3 and [r.sample_idx for r in few if r.variant_idx == 0] == [4, 2, 4]
    with open(f"{tmp_path}/bad.bed", "wb") as f:
        f.write(b"\x00\x00\x00" + b"\x01" * 160)
    for path, n in ((f"{tmp_path}/bad.bed", 13), (f"{tmp_path}/d.bed", 99)):
        with pytest.raises(Exception, match="PLINK|fit n_samples"):
            plink.read_bed(spark, path, n).count()


def test_simulation(spark):
    v = spark.range(60).select(F.col("id").cast("int").alias("variant_idx"), F.lit("1").alias("chr"), F.col("id").alias("pos"))
    blocks = v.select("variant_idx", (F.col("variant_idx") / 6).cast("int").alias("block"))
    add = v.where("variant_idx in (1, 13, 25, 40)")
    got = simulate.interaction_pairs(v, add, 15, 0.4, False, 3, blocks, True, True).collect()
    held, causal = {1 // 6, 13 // 6, 25 // 6, 40 // 6}, {1, 13, 25, 40}
    assert len(got) == len({(r.i, r.j) for r in got}) == 15 and sum(r.kind == "overlap" for r in got) == 6
    for r in got:
        assert r.i < r.j and r.i // 6 != r.j // 6
        assert bool({r.i, r.j} & causal) == (r.kind == "overlap") and (r.kind == "overlap" or not {r.i // 6, r.j // 6} & held)
    both = simulate.interaction_pairs(v, add, 4, 1.0, True, 3).collect()
    assert both and all({r.i, r.j} <= causal for r in both)
    parts = spark.range(4000).select(F.col("id").alias("sample_idx"), F.lit("train").alias("split"), simulate.hash_normal("id", seed=1).alias("a"), simulate.hash_normal("id", seed=2).alias("b"))
    got = simulate.liability(parts, {"a": 0.3, "b": 0.2}, 5).agg(F.var_pop("liability"), F.corr("liability", "a")).first()
    assert abs(got[0] - 1) < 0.08 and abs(got[1] - 0.3**0.5) < 0.05
    with pytest.raises(ValueError):
        simulate.liability(parts, {"a": 0.6, "b": 0.4}, 5)
    record = simulate.manifest(add.select("variant_idx", F.lit(0.1).alias("beta")), spark.createDataFrame([(1, 2)], "i long, j long"), v, {"h_add": 0.3})
    assert record["settings"].first()["value"] == 0.3 and record["pairs"].first()["pos_j"] == 2 and record["additive"].count() == 4


def test_two_snp_grid(spark):
    """A strong product effect is what a tree sees and a line doesn't; errors are those of the rows themselves."""
    rng = np.random.default_rng(4)
    g = rng.binomial(2, 0.4, (3000, 3))
    calls = spark.createDataFrame([(i, j, None if (i + j) % 40 == 0 else int(g[i, j])) for i in range(3000) for j in range(3)], "sample_idx long, variant_idx int, dosage int")
    samples = spark.createDataFrame([(i, "train" if i % 2 else "test") for i in range(3000)], "sample_idx long, split string")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 9)], "i int, j int")
    got = {(r.i, r.j, r.h_epi, r.depth): r for r in simulate.two_snp_grid(calls, samples, pairs, depths=(1, 4), shares=(0.0, 0.6), h_add=0.2).collect()}
    assert len(got) == 2 * 2 * 2 and all(abs(r.delta - (r.mse_linear - r.mse_tree)) < 1e-9 for r in got.values())
    for i, j in ((0, 1), (1, 2)):
        assert got[i, j, 0.6, 4].delta > got[i, j, 0.0, 4].delta - 1e-9 and got[i, j, 0.6, 4].delta > 0 and got[i, j, 0.0, 4].mse_tree < 1.1
        assert got[i, j, 0.6, 4].mse_tree < got[i, j, 0.6, 1].mse_tree


def test_ensemble(spark):
    got = catalog.QUERIES["ensemble_one_patch"](spark, "/root/testdata/sf0.01").toPandas()
    wide = got.pivot_table(index=["estimator_idx", "sample_idx"], columns="member", values="pred")
    assert np.allclose(wide["mean"], wide[["linear_l2", "elasticnet", "bayesian"]].mean(axis=1), atol=2e-6)
    x = models.patch(spark, "/root/testdata/sf0.01", "y_cont")
    alone = estimators.fit_patches(x, "linear_l2").where("estimator_idx = 0").toPandas().set_index("variant_idx")["coef"]
    w = x.where("estimator_idx = 0").toPandas().pivot(index="sample_idx", columns="variant_idx", values="x").fillna(0.0)
    want = w.to_numpy() @ alone.reindex(w.columns).to_numpy() + alone[-1]
    assert np.allclose(wide.loc[0]["linear_l2"].reindex(w.index), want, atol=1e-5)
