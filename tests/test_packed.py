"""Members fitted over packed blocks: by levels and by Gram tiles, against the fits that hold a patch whole."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import boosting, estimators, gram, level_trees, packed, stats

N, M = 700, 9


@pytest.fixture(scope="module")
def cohort(spark):
    """Two estimators with samples and variants of their own; missing calls, a variant copied exactly, weights and offsets."""
    rng = np.random.default_rng(8)
    g = rng.integers(0, 3, (N, M)).astype(float)
    g[:, 5] = g[:, 2]
    gone = rng.random((N, M)) < 0.05
    gone[:, 5] = gone[:, 2]
    score = 1.5 * g[:, 1] - g[:, 2] + 0.7 * g[:, 3] * g[:, 4]
    y = score + rng.standard_normal(N)
    people = {"y": y, "c": (y > np.median(y)).astype(float), "weight": rng.integers(1, 4, N).astype(float), "offset": 0.3 * rng.standard_normal(N), "check": np.arange(N) % 5 == 0}
    calls = spark.createDataFrame([(i, 10 * j, None if gone[i, j] else int(g[i, j])) for i in range(N) for j in range(M) if (i + j) % 50 != 7], "sample_idx long, variant_idx int, dosage int")
    known = spark.createDataFrame([(i, *[v[i].item() for v in people.values()]) for i in range(N)], "sample_idx long, y double, c double, weight double, offset double, check boolean")
    own = spark.createDataFrame([(e, i) for e in range(2) for i in range(N) if (i + e) % 3], "estimator_idx int, sample_idx long")
    ids = [10 * j for j in range(M)]
    maf, a0 = np.where(np.arange(M) == 8, np.nan, 0.3), np.full(M, 0.4)
    places = {0: np.arange(M), 1: np.array([1, 2, 4, 5, 6])}
    x = packed.values(maf, a0)
    codes = np.where(gone, 3, g).astype(int)
    codes[np.add.outer(np.arange(N), np.arange(M)) % 50 == 7] = 3
    dense = {e: (np.array([i for i in range(N) if (i + e) % 3]), p) for e, p in places.items()}
    wide = {e: np.stack([x[j][codes[rows, j]] for j in p], axis=1) for e, (rows, p) in dense.items()}
    return calls, known, own, ids, places, x, dense, wide, people


@pytest.fixture(params=[40, 1 << 20])
def cells(request, monkeypatch):
    """Blocks of a few samples, and of all."""
    monkeypatch.setattr(packed, "CELLS", request.param)
    return request.param


def made_of(cohort, label="y", more=()):
    calls, known, own, ids, places, x, dense, wide, people = cohort
    return packed.patch_blocks(calls, known.select("sample_idx", F.col(label).alias("y"), *more), own, ids, places), {e: x[p] for e, p in places.items()}


def test_blocks_hold_the_patch(cohort, cells):
    made, x = made_of(cohort, more=("weight",))
    dense, wide, people = cohort[6], cohort[7], cohort[8]
    bs = [packed.unpacked(r.asDict()) for r in made.collect()]
    assert all(b.codes.size < cells + M for b in bs)
    for e, (rows, _) in dense.items():
        own = [b for b in bs if b.estimator == e]
        ids = np.concatenate([b.ids for b in own])
        order = np.argsort(ids)
        assert (ids[order] == rows).all()
        got = np.concatenate([np.take_along_axis(x[e], b.codes, axis=1) for b in own], axis=1).T[order]
        assert np.allclose(got, wide[e])
        assert (np.concatenate([b.weight for b in own])[order] == people["weight"][rows]).all()


@pytest.mark.parametrize("kind", ["lightgbm", "xgboost", "catboost", "random_forest"])
@pytest.mark.parametrize("classes,more", [(False, ()), (True, ("weight",)), (False, ("weight", "offset", "check"))])
def test_levels_grow_the_same_trees(spark, cohort, monkeypatch, kind, classes, more):
    if more and kind in ("xgboost", "random_forest"):
        pytest.skip("the other kinds show it")
    monkeypatch.setattr(packed, "CELLS", 1500)
    monkeypatch.setattr(packed, "TILE", 4)
    monkeypatch.setattr(level_trees, "TILE", 4)
    dense, wide, people = cohort[6], cohort[7], cohort[8]
    label = "c" if classes else "y"
    made, x = made_of(cohort, label, more)
    there = packed.scored(made, "variance", x, classes)
    patches = {e: level_trees.Patch(np.array(cohort[3])[cohort[4][e]], x[e], there[e][1]) for e in x}
    settings = {"with_offset": "offset" in more, "check": "check" in more, "seed": 5, "settings": {"rounds": 4, "depth": 3}}
    far = {r.estimator_idx: r for r in level_trees.fit_packed(made, patches, x, [kind], classes, whole=0, **settings).collect()}
    near = {r.estimator_idx: r for r in level_trees.fit_packed(made, patches, x, [kind], classes, **settings).collect()}
    for e, (rows, places) in dense.items():
        alone = boosting.fit_trees(wide[e], people[label][rows], kind, classes, *[people[c][rows] if c in more else None for c in ("weight", "offset", "check")], seed=5 + e, ids=rows, settings=settings["settings"])
        used, alone = boosting.pruned(alone, [cohort[3][j] for j in places])
        for got in (far[e], near[e]):
            model = json.loads(got.model)
            assert list(got.variants) == used and len(model["trees"]) == len(alone["trees"])
            assert flat(model["trees"]) == pytest.approx(flat(alone["trees"]), abs=1e-9) and abs(model["base"] - alone["base"]) < 1e-9
            assert flat(model["cuts"]) == pytest.approx(flat(alone["cuts"]))


def flat(v):
    return [x for part in v for x in flat(part)] if isinstance(v, list) else [v]


def test_packed_reading(spark, cohort):
    calls, known, own, ids, places, x, dense, wide, people = cohort
    made, xs = made_of(cohort)
    there = packed.scored(made, "variance", xs, False)
    patches = {e: level_trees.Patch(np.array(ids)[places[e]], xs[e], there[e][1]) for e in xs}
    members = level_trees.fit_packed(made, patches, xs, ["lightgbm", "catboost"], scale=(100.0, 10.0))
    table = spark.createDataFrame([(v, None if np.isnan(m) else float(m), 0.4) for v, m in zip(ids, np.where(np.arange(M) == 8, np.nan, 0.3))], "variant_idx int, maf double, a0_freq double")
    one = spark.createDataFrame([(10_000, 777, 1)], calls.schema)  # calls of other variants alone
    got = {(r.estimator_idx, r.sample_idx): r.pred for r in level_trees.read_packed(calls.unionByName(one), table, members).collect()}
    assert len(got) == 2 * (N + 1)
    for e, (rows, _) in dense.items():
        want = [100 + 10 * boosting.read_trees(boosting.fit_trees(wide[e], people["y"][rows], k, seed=22 + e, ids=rows), wide[e]) for k in ("lightgbm", "catboost")]
        assert np.allclose([got[e, i] for i in rows], np.mean(want, axis=0), atol=1e-6)


@pytest.mark.parametrize("model", ["linear_l1", "linear_l2", "elasticnet", "bayesian", "logistic", "logistic_l1", "logistic_elasticnet"])
def test_gram_members(cohort, monkeypatch, model):
    monkeypatch.setattr(packed, "CELLS", 1500)
    monkeypatch.setattr(packed, "TILE", 4)
    monkeypatch.setattr(gram, "TILE", 4)
    label = "c" if "logistic" in model else "y"
    made, x = made_of(cohort, label)
    got = gram.fit(made, x, model)
    for e, (rows, _) in cohort[6].items():
        b, a = estimators.MODELS[model](cohort[7][e], cohort[8][label][rows])
        fitted = cohort[7][e] @ got[e][:-1] + got[e][-1]
        assert np.allclose(fitted, cohort[7][e] @ b + a, atol=2e-4), model  # copies of a variant share their effect in any way


def test_gram_weights_count_rows(cohort, monkeypatch):
    """A weight of k is k rows, in every loss."""
    made, x = made_of(cohort, "c", ("weight",))
    for model in ("linear_l1", "logistic_l1"):
        got = gram.fit(made, x, model)
        for e, (rows, _) in cohort[6].items():
            times = np.repeat(np.arange(len(rows)), cohort[8]["weight"][rows].astype(int))
            b, a = estimators.MODELS[model](cohort[7][e][times], cohort[8]["c"][rows][times])
            assert np.allclose(cohort[7][e] @ got[e][:-1] + got[e][-1], cohort[7][e] @ b + a, atol=2e-4)


def test_selection_scores(spark, cohort):
    calls, known, own, ids, places, x, dense, wide, people = cohort
    rows, _ = dense[0]
    for label, classes, names in (("y", False, ("f_regression", "r_regression", "variance", "mutual_info")), ("c", True, ("f_regression", "chi2", "mutual_info"))):
        made, xs = made_of(cohort, label)
        y = people[label][rows]
        bounds = np.quantile(y, [0.2, 0.4, 0.6, 0.8]).tolist()
        full = spark.createDataFrame([(i, v) for i in range(N) for v in ids], "sample_idx long, variant_idx int").join(calls.withColumnRenamed("dosage", "d"), ["sample_idx", "variant_idx"], "left")
        table = full.join(own.where("estimator_idx = 0"), "sample_idx").join(known.select("sample_idx", F.col(label).alias("y")), "sample_idx")
        for how in names:
            score, _ = packed.scored(made, how, xs, classes, bounds)[0]
            if how in ("chi2", "mutual_info"):
                of = table.withColumn("dosage", F.col("d") if how == "chi2" else F.coalesce("d", F.lit(3))).where("dosage is not null")
                of = of if classes else of.withColumn("y", sum(((F.col("y") > b).cast("int") for b in bounds[1:]), (F.col("y") > bounds[0]).cast("int")))
                if how == "chi2":  # class shares are those of the variant's own calls
                    want = {r.variant_idx: r.score for r in stats.chi2(of).collect()}
                else:
                    want = {r.variant_idx: r.score for r in stats.mutual_info(of).collect()}
                assert np.allclose(score, [want[v] for v in ids], equal_nan=True), how
            else:
                w = wide[0]
                r = np.array([np.corrcoef(w[:, j], y)[0, 1] if w[:, j].std() > 0 else np.nan for j in range(M)])
                want = {"variance": w.var(axis=0), "r_regression": r, "f_regression": r * r / (1 - r * r) * (len(y) - 2)}[how]
                assert np.allclose(score, want, equal_nan=True), how


def test_elimination_by_downdating():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (300, 12)).astype(float)
    y = x @ np.arange(12) * 0.3 + rng.standard_normal(300)
    xc, left, want = x - x.mean(0), list(range(12)), np.ones(12)
    while len(left) > 4:
        b = np.abs(np.linalg.lstsq(xc[:, left], y - y.mean(), rcond=None)[0])
        gone = left.pop(len(b) - 1 - int(np.argmin(b[::-1])))
        want[gone] = len(left) - 4 + 2
    assert (gram.eliminated(xc.T @ xc / 300, xc.T @ (y - y.mean()) / 300, 4) == want).all()


def test_forest_draws():
    times = boosting.poisson(np.arange(200_000), 3, 1)
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02 and (times != boosting.poisson(np.arange(200_000), 3, 2)).any()


def test_dosages_are_checked(spark):
    with pytest.raises(Exception, match="dosage"):
        packed.pack(spark.createDataFrame([(1, 0, 3)], "sample_idx long, variant_idx int, dosage int"), [0]).collect()
