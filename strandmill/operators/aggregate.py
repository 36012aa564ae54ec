"""Ensemble aggregation: filters, weights, folding of coefficients, early stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import mid_rank

def everything():
    return Window.partitionBy()


def kept_estimators(scores: DataFrame, how: str, threshold: float = 0.5, p: float = 0.75, group_size: int = 1) -> DataFrame:
    """Scores of the estimators that a filter keeps; members of a group stand or fall together; if none passes, all stay."""
    if group_size > 1:
        scores = scores.withColumn("score", F.avg("score").over(Window.partitionBy(F.floor(F.col("estimator_idx") / group_size))))
    bar = {"none": F.lit(float("-inf")), "positive": F.lit(threshold), "geq-average": F.avg("score").over(everything()), "top-p-percentile": F.expr(f"percentile(score, {p}D) over ()")}[how]
    s = scores.withColumn("_ok", F.col("score") >= bar).withColumn("_any", F.max("_ok").over(everything()))
    return s.where(F.col("_ok") | ~F.col("_any")).drop("_ok", "_any")


def softmax(scores: DataFrame, temperature: float) -> DataFrame:
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    e = F.exp((F.col("score") - F.max("score").over(everything())) / temperature)
    return scores.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(everything())).drop("_e")


def mean(preds: DataFrame) -> DataFrame:
    return preds.groupBy("sample_idx").agg(F.coalesce(F.avg("pred"), F.lit(0.0)).alias("pred"))


def rank_mean(preds: DataFrame, compat: bool = False) -> DataFrame:
    """Ranks of samples within an estimator, averaged; with compat ranks of estimators within a sample (a constant)."""
    return mid_rank(preds, "pred", ["sample_idx" if compat else "estimator_idx"]).groupBy("sample_idx").agg(F.avg("rank").alias("pred"))


def weighted_mean(preds: DataFrame, weights: DataFrame) -> DataFrame:
    w = F.when(F.col("pred").isNotNull(), F.col("weight"))
    return preds.join(F.broadcast(weights.select("estimator_idx", "weight")), "estimator_idx").groupBy("sample_idx").agg((F.sum(F.col("weight") * F.col("pred")) / F.nullif(F.sum(w), F.lit(0.0))).alias("pred"))


def fold_coefficients(coefs: DataFrame, estimators: int) -> DataFrame:
    """A variant's mean coefficient over all estimators, absent ones counting as 0."""
    return coefs.groupBy("variant_idx").agg((F.sum("coef") / estimators).alias("coef"))


def score_samples(x: DataFrame, coefs: DataFrame) -> DataFrame:
    """Linear scores over variants with a coefficient other than 0. The coefficients are pruned before the join."""
    c = coefs.where("coef <> 0").select("variant_idx", "coef")
    return x.join(c, "variant_idx").groupBy("sample_idx").agg(F.sum(F.col("x") * F.col("coef")).alias("prs"))


def merged_interactions(edges: DataFrame) -> DataFrame:
    """Mean value of each unordered pair; absent pairs do not count."""
    return edges.groupBy(F.least("variant_i", "variant_j").alias("variant_i"), F.greatest("variant_i", "variant_j").alias("variant_j")).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("value"))


def early_stop(metric: DataFrame, patience: int) -> DataFrame:
    """(stop, best) for rows (batch, value): the first batch after `patience` batches without a new best, else the last."""
    w = Window.orderBy("batch")
    best = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = metric.withColumn("up", (best.isNull() | (F.col("value") > best)).cast("int"))
    m = m.withColumn("island", F.sum("up").over(w)).withColumn("_c", F.sum(1 - F.col("up")).over(Window.partitionBy("island").orderBy("batch")))
    stop = F.coalesce(F.min(F.when(F.col("_c") >= patience, F.col("batch"))).over(everything()), F.max("batch").over(everything()))
    return m.withColumn("stop", stop).where("batch <= stop").groupBy("stop").agg(F.max(F.when(F.col("up") == 1, F.col("batch"))).alias("best"))
