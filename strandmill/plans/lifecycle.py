"""Training and prediction as one call: statistics, patches, weak estimators, selection, folding, scores.

All weak estimators are fitted in one job and the stop is applied afterwards: they are independent given their seeds and
the stop depends on a prefix only, so the ensemble is the same as that of a loop that ends early.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..operators import aggregate as A
from ..operators import estimators as E
from ..operators import gram as G
from ..operators import level_trees as T
from ..operators import packed as K
from ..operators import qc as Q
from ..operators import sampling as P
from ..operators import selection as N
from ..operators import stats as S
from ..operators.storage import cut
from ..sources import cache


#: Bins of a continuous label, for its mutual information with dosages.
Y_BINS = 5


def _metric(rows: DataFrame, scorer: str, by: str) -> DataFrame:
    make, name = {"rocauc": (S.auc, "auc"), "r2": (S.r2, "r2"), "pearson_corr": (S.pearson, "pearson")}[scorer]
    return make(rows, "pred", "y", [by]).select(by, F.coalesce(name, F.lit(0.0)).alias("score"))


def _scores(x: DataFrame, coefs: DataFrame) -> DataFrame:
    """(estimator_idx, sample_idx, pred): linear scores by estimator, intercepts (variant -1) added. Every sample of x
    gets a row from every estimator, since a patch's variants are all in x."""
    slopes, base = coefs.where("variant_idx >= 0"), coefs.where("variant_idx < 0").select("estimator_idx", F.col("coef").alias("_a"))
    sums = x.join(slopes, "variant_idx").groupBy("estimator_idx", "sample_idx").agg(F.sum(F.col("x") * F.col("coef")).alias("_s"))
    return sums.join(F.broadcast(base), "estimator_idx").select("estimator_idx", "sample_idx", (F.col("_s") + F.col("_a")).alias("pred"))  # a row for each estimator


class Patches:
    """All estimators' patches, packed: blocks, and of each estimator its variants and what their codes are worth."""

    def __init__(self, calls: DataFrame, taught: DataFrame, own: DataFrame, plan: DataFrame, stats: DataFrame):
        rows = plan.groupBy("estimator_idx").agg(F.array_sort(F.collect_list("variant_idx")).alias("v")).collect()  # parameters: estimators and their variants
        self.variants = {r["estimator_idx"]: np.array(r["v"], int) for r in rows}
        ids = sorted(set().union(*(map(int, v) for v in self.variants.values())))
        x = T.worth(stats, ids)
        places = {e: np.searchsorted(ids, v) for e, v in self.variants.items()}
        self.x = {e: x[p] for e, p in places.items()}
        self.blocks = K.patch_blocks(calls, taught, own, ids, places)
        self.present: dict[int, np.ndarray] = {}

    def select(self, how: str, k: int, classes: bool, bounds: list[float] | None = None) -> None:
        """Keeps the k best variants of each patch (percentile: the best k percent). auto is the F statistic of the task, which
        orders variants of two classes and of values alike."""
        if how == "rfe":
            scores = {e: -r for e, r in G.ranks(self.blocks, self.x, k).items()}
        else:
            scores = {e: s for e, (s, _) in K.scored(self.blocks, how, self.x, classes, bounds).items()}
        kept = {}
        for e, s in scores.items():
            n = max(1, len(s) * k // 100) if how == "percentile" else k
            kept[e] = np.sort(np.argsort(-np.nan_to_num(s, nan=-np.inf), kind="stable")[:n])
        self.blocks = cut(K.narrowed(self.blocks, kept))
        self.variants, self.x = ({e: of[e][p] for e, p in kept.items()} for of in (self.variants, self.x))

    def trees(self, kinds: list[str], classes: bool, **settings) -> DataFrame:
        there = K.scored(self.blocks, "variance", self.x, classes)
        patches = {e: T.Patch(self.variants[e], self.x[e], present) for e, (_, present) in there.items()}
        return T.fit_packed(self.blocks, patches, self.x, kinds, classes, **settings)

    def linear(self, model: str) -> DataFrame:
        """(estimator_idx, variant_idx, coef) by Gram tiles; stochastic members pass over their whole patch in one task."""
        spark = self.blocks.sparkSession
        if model not in G.KINDS:
            return E.fit_blocks(self.blocks, self.variants, self.x, model)
        fitted = G.fit(self.blocks, self.x, model)
        rows = [(e, v, float(c)) for e, b in fitted.items() for v, c in zip([*map(int, self.variants[e]), -1], b)]
        return spark.createDataFrame(rows, "estimator_idx int, variant_idx int, coef double")


@dataclass
class Fitted:
    """stats: training statistics of the variants that pass; members: the kept estimators' coefficients, or their trees;
    weights: their scores and weights, and how they are put together; coefs: the folded linear model, variant -1 the
    intercept (empty for trees, and for rank-mean never used)."""

    stats: DataFrame
    members: DataFrame
    weights: DataFrame
    coefs: DataFrame

    def predict(self, calls: DataFrame) -> DataFrame:
        """(sample_idx, pred): scores of all samples, with the training statistics. Null calls are imputed."""
        x = Q.standardize(calls, self.stats)
        trees, ranks = "model" in self.members.columns, self.weights.select("how").first()
        if trees or (ranks and ranks["how"] == "rank-mean"):
            preds = T.read_packed(calls, self.stats, self.members) if trees else _scores(x, self.members)
            return A.rank_mean(preds) if ranks and ranks["how"] == "rank-mean" else A.weighted_mean(preds, self.weights)
        base = self.coefs.where("variant_idx = -1").select(F.col("coef").alias("_a"))
        return A.score_samples(x, self.coefs.where("variant_idx >= 0")).join(F.broadcast(base)).select("sample_idx", (F.col("prs") + F.col("_a")).alias("pred"))  # one row


def train(calls: DataFrame, samples: DataFrame, config: Config, margin: bool = False, folder: str | None = None) -> Fitted:
    """calls (sample_idx, variant_idx, dosage); samples (sample_idx, y, split and, if they are there, population, weight,
    offset and check) with splits train, val and, where the configuration filters or weights estimators, agg; samples
    without a label teach nothing. Weights count for trees and for linear members but stochastic ones, offsets for trees;
    rows that check teach nothing and stop the boosting. With `margin` boosted trees of classes predict log odds.
    A folder keeps the training statistics for other trainings on the same samples and files."""
    model, data = config.model, config.data
    more = [c for c in ("population", "weight", "offset", "check") if c in samples.columns]
    known = samples.where("y is not null").select("sample_idx", F.col("y").cast("double").alias("y"), "split", *more)
    rows = known.where("split = 'train'")
    if data.outlier_threshold and not data.classification:
        rows = Q.without_outliers(rows, "y", data.outlier_threshold)
    if data.scale_labels:
        scale = cut(N.label_scale(rows, "y"))
        rows = N.standardised_label(rows, "y", scale)
    if folder is None:
        found = Q.variant_stats(calls.join(rows.select("sample_idx"), "sample_idx", "left_semi"))
    else:
        found = cache.statistics(calls.sparkSession, folder, calls, rows, Q.variant_stats)
    stats = cut(Q.filter_variants(found, data.maf_threshold, data.missingness_threshold))
    x = Q.standardize(calls, stats)
    own = cut(P.sample_plan(rows, model.n_estimators, data.max_samples, config.train.seed, data.draw, data.fixed_draw, data.controls_per_case))
    plan = P.variant_plan(stats, model.n_estimators, data.max_features, config.train.seed)
    patches = Patches(calls, rows.select("sample_idx", "y", *(c for c in more if c != "population")), own, plan, stats)
    if model.k_best:
        bounds = rows.agg(F.percentile_approx("y", [i / Y_BINS for i in range(1, Y_BINS)])).first()[0] if model.selection == "mutual_info" and not data.classification else None
        patches.select(model.selection, model.k_best, data.classification, sorted(set(bounds or [])))
    if model.trees:
        back = tuple(scale.select("mean", "sd").first()) if data.scale_labels else None
        coefs = cut(patches.trees(model.members, model.class_loss, with_offset="offset" in more, check="check" in more, scale=back, margin=margin))
    else:
        each = [patches.linear(m) for m in model.members]
        coefs = each[0]
        for other in each[1:]:  # an estimator's linear members fold to their mean
            coefs = coefs.unionByName(other)
        if len(each) > 1:
            coefs = coefs.groupBy("estimator_idx", "variant_idx").agg((F.sum("coef") / len(each)).alias("coef"))
        if data.scale_labels:
            back = coefs.crossJoin(F.broadcast(scale))  # one row
            coefs = back.select("estimator_idx", "variant_idx", (F.col("coef") * F.col("sd") + F.when(F.col("variant_idx") < 0, F.col("mean")).otherwise(0.0)).alias("coef"))
        coefs = cut(coefs)

    def scored(split: str) -> DataFrame:
        some = known.where(F.col("split") == split).select("sample_idx", "y")
        mine = lambda rows: rows.join(some.select("sample_idx"), "sample_idx", "left_semi")
        return (T.read_packed(mine(calls), stats, coefs) if model.trees else _scores(mine(x), coefs)).join(some, "sample_idx")

    if config.train.patience > 0:
        upto = Window.partitionBy("sample_idx").orderBy("estimator_idx").rowsBetween(Window.unboundedPreceding, 0)
        running = scored("val").withColumn("pred", F.avg("pred").over(upto))
        ends = (F.col("estimator_idx") + 1) % config.train.batch_size == 0
        batches = _metric(running.where(ends), config.scorer, "estimator_idx").select(F.floor(F.col("estimator_idx") / config.train.batch_size).alias("batch"), F.col("score").alias("value"))
        stop = A.early_stop(batches, config.train.patience).first()
        if stop is not None:
            coefs = coefs.where(F.col("estimator_idx") < (stop["best"] + 1) * config.train.batch_size)
    if config.model.needs_hold_out:
        kept = A.kept_estimators(_metric(scored("agg").join(coefs.select("estimator_idx").distinct(), "estimator_idx", "left_semi"), config.scorer, "estimator_idx"), config.model.filter_strat, config.model.bar(config.data.classification), config.model.p)
    else:
        kept = coefs.select("estimator_idx").distinct().withColumn("score", F.lit(None).cast("double"))
    if config.model.agg_strat == "loss-weighted-average":
        weights = A.softmax(kept, config.model.temp)
    else:
        weights = kept.withColumn("weight", 1 / F.count("*").over(A.everything()))
    weights = cut(weights.withColumn("how", F.lit(config.model.agg_strat)))
    members = coefs.join(F.broadcast(weights.select("estimator_idx", "weight")), "estimator_idx")  # a row for each estimator
    if model.trees:
        return Fitted(stats, members.drop("weight"), weights, cut(E.none(members)))
    folded = cut(members.groupBy("variant_idx").agg(F.sum(F.col("weight") * F.col("coef")).alias("coef")))
    return Fitted(stats, members.select("estimator_idx", "variant_idx", "coef"), weights, folded)
