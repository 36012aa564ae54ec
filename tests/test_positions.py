"""Positions and what is built on them, on tables of 100,000 rows with more columns than the functions use."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import sampling, selection, stats

N = 100_000


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    """Rows in no order, from seven files, with columns of their own beside the key."""
    path = f"file://{tmp_path_factory.mktemp('people')}/rows"
    rows = spark.range(N).select((F.col("id") * 3).alias("sample_idx"), "id", F.md5(F.col("id").cast("string")).alias("note"), (F.col("id") % 10).alias("group"), F.rand(7).alias("_r"))
    rows.repartition(7, "_r").drop("_r").write.parquet(path)
    return spark.read.parquet(path)


def test_numbered(people):
    got = sampling.numbered(people, ["sample_idx"], "at").select("id", "at", "note").toPandas()
    assert (got["id"] == got["at"]).all() and got["at"].nunique() == N and got["note"].notna().all()


def test_numbered_with_ties_and_nulls(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("k"), "id")
    got = sampling.numbered(rows, ["k", "id"], "at").orderBy("at").toPandas()
    assert got["at"].tolist() == list(range(20_000))
    keys = [(-1 if np.isnan(k) else k, i) for k, i in zip(got["k"], got["id"])]
    assert keys == sorted(keys)
    assert sampling.numbered(rows.limit(0), ["id"]).count() == 0


def test_head_tail(people):
    got = sampling.head_tail(people, 0.2).toPandas()
    assert (got["is_train"] == (got["id"] < 80_000)).all() and len(got) == N
    drawn = sampling.head_tail(people, 0.2, seed=5).toPandas()
    assert drawn["is_train"].sum() == 80_000 and 15_000 < drawn.loc[drawn["id"] >= 80_000, "is_train"].sum() < 17_000


@pytest.mark.parametrize("k", [5, 7])
def test_kfold(people, k):
    got = sampling.kfold(people, k).toPandas().sort_values("id")
    want = np.concatenate([np.full(len(x), i) for i, x in enumerate(np.array_split(np.arange(N), k))])
    assert (got["fold"].to_numpy() == want).all()


def test_bootstrap(people):
    got = sampling.bootstrap(people, 22).toPandas()
    assert got["multiplicity"].sum() == N and got["id"].nunique() == len(got) and 0.6 < len(got) / N < 0.66


def test_by_position(people):
    got = selection.by_position(people, "sample_idx", 10_000, 21_000, 2).toPandas()
    assert sorted(got["id"]) == list(range(10_000, 21_000, 2))


def test_top_percent(spark):
    scores = spark.range(N).select(F.col("id").cast("int").alias("variant_idx"), F.when(F.col("id") % 1000 == 1, None).otherwise((F.col("id") * 7919 % N).cast("double")).alias("score"), F.lit("x").alias("note"))
    got = stats.top_percent(scores, 50).toPandas()
    every = [i * 7919 % N for i in range(N) if i % 1000 != 1]
    assert sorted(got["score"], reverse=True) == sorted(every, reverse=True)[: len(every) // 2]


def test_numbered_in_groups(people):
    got = sampling.numbered(people.withColumn("group", F.when(F.col("group") == 3, None).otherwise(F.least("group", F.lit(5)))), ["sample_idx"], "at", ["group"]).toPandas()
    for _, own in got.fillna({"group": -1}).groupby("group"):
        assert own.sort_values("id")["at"].tolist() == list(range(len(own)))


def test_bottom_k(spark, people):
    rows = people.withColumn("group", F.when(F.col("group") == 3, None).otherwise(F.col("group")))
    order = F.md5(F.col("sample_idx").cast("string"))
    most = F.when(F.col("group") == 1, 0).when(F.col("group") == 2, 1).when(F.col("group") == 4, 10_000_000).otherwise(777)
    got = sampling.bottom_k(rows, order, "sample_idx", most, ["group"])
    assert got.columns == rows.columns
    from pyspark.sql import Window

    want = rows.withColumn("_i", F.row_number().over(Window.partitionBy("group").orderBy(order, "sample_idx"))).where(F.col("_i") <= F.when(F.col("group").isNull(), 777).otherwise(most))
    assert sorted(r[0] for r in got.select("id").collect()) == sorted(r[0] for r in want.select("id").collect())
    assert sampling.bottom_k(rows, order, "sample_idx", F.lit(0)).count() == 0 and sampling.bottom_k(rows.limit(0), order, "sample_idx", F.lit(5)).count() == 0


def test_draws_shuffle_no_crossed_rows(spark, people):
    """The crossed table isn't shuffled: only counts by cell and the rows of one cell are."""
    plan = sampling.variant_plan(people.select(F.col("sample_idx").alias("variant_idx")), 4, 100, 22)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(estimator_idx" in text and text.count("Exchange hashpartitioning") <= 5  # counts and their sums, looked up twice, and the last cell
    rows = plan.toPandas()
    assert (rows.groupby("estimator_idx").size() == 100).all()


def test_ranks_of_many_scores(spark):
    rng = np.random.default_rng(4)
    n = 1_000_000
    score = np.where(rng.random(n) < 0.3, 0.25, rng.normal(size=n).round(5))
    score[:5] = [0.0, -0.0, 1e-300, -1e9, 1e9]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"g": "all", "s": score, "y": (rng.random(n) < 0.4).astype(int)})).repartition(8).cache()
    ranks = pd.Series(score).rank()
    got = stats.mid_rank(df, "s", ["g"]).toPandas()
    assert len(got) == n and np.allclose(got["rank"], got["s"].map(dict(zip(score, ranks))))
    y = df.select("s", "y").toPandas()
    r = y["s"].round(9).rank()
    p = y["y"].sum()
    want = (r[y["y"] == 1].sum() - p * (p + 1) / 2) / (p * (n - p))
    assert abs(stats.auc(df, "s", "y", ["g"]).first()["auc"] - want) < 1e-9


def test_value_ranges_grow(spark):
    rng = np.random.default_rng(1)
    v = np.sort(np.concatenate([rng.normal(size=2000), 10.0 ** rng.uniform(-12, 12, 2000), -(10.0 ** rng.uniform(-12, 12, 2000)), np.nextafter(2.0 ** np.arange(-20, 20), 0), 2.0 ** np.arange(-20, 20)]))
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in v], "v double").select(stats.value_range(F.col("v"))).collect()]
    assert got == sorted(got)


def test_shuffled_folds(people):
    got = sampling.kfold(people, 5, shuffle=3).toPandas()
    assert got["fold"].value_counts().tolist() == [N // 5] * 5 and got["id"].nunique() == N and (got["sample_idx"] == 3 * got["id"]).all()
    assert abs(np.corrcoef(got["id"], got["fold"])[0, 1]) < 0.02
