"""Covariates first, genotypes on what they leave, and the two predictions fused.

The covariate model predicts training rows out of fold, so that its residuals aren't shrunk, and all other rows by a fit
on all training rows. Covariates are scaled by training statistics only; a missing one counts as the training mean.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import covar as C
from ..operators.storage import cut
from . import lifecycle

STRATEGIES = ("predictive", "residualization", "yeo-johnson", "offset")


@dataclass
class CovariateModel:
    names: list[str]
    scale: dict[str, tuple[float, float]]
    fitted: object
    classification: bool

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds covar: the value, or the probability of class 1."""
        from pyspark.ml.functions import vector_to_array

        out = self.fitted.transform(vectors(rows, self.names, self.scale))
        pred = vector_to_array("probability")[1] if self.classification else F.col("prediction")
        return out.select(*rows.columns, pred.alias("covar"))


def vectors(rows: DataFrame, names: list[str], scale: dict[str, tuple[float, float]]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    z = [F.coalesce((F.col(n).cast("double") - F.lit(scale[n][0])) / F.lit(scale[n][1]), F.lit(0.0)) for n in names]
    return rows.withColumn("_covariates", array_to_vector(F.array(*z)))


def fit(rows: DataFrame, names: list[str], label: str, classification: bool) -> CovariateModel:
    """Least squares, or logistic regression with an L2 penalty of C = 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression

    sums = [F.count("*").alias("_n"), *[f(F.col(n).cast("double")).alias(f"{k}{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]]
    got = rows.agg(*sums).first()
    scale = {n: (got[f"m{n}"] or 0.0, got[f"s{n}"] or 1.0) for n in names}
    shared = {"featuresCol": "_covariates", "labelCol": label, "standardization": False}
    make = LogisticRegression(regParam=1 / max(got["_n"], 1), **shared) if classification else LinearRegression(solver="normal", **shared)
    return CovariateModel(names, scale, make.fit(vectors(rows, names, scale)), classification)


def out_of_fold(rows: DataFrame, names: list[str], label: str, classification: bool, key: str = "sample_idx", k: int = 5, seed: int = 22) -> DataFrame:
    """Adds covar to every row: its fold's prediction by a fit on the other folds. Folds come from the hash of the key."""
    rows = cut(rows.withColumn("_fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k))))
    out = None
    for i in range(k):
        model = fit(rows.where(F.col("_fold") != i), names, label, classification)
        part = model.predict(rows.where(F.col("_fold") == i))
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold")


@dataclass
class Fused:
    """scale: exponent, mean and deviation of the transformed training residuals, where the strategy transforms them."""

    covariates: CovariateModel
    genotypes: lifecycle.Fitted
    strategy: str
    classification: bool
    scale: tuple[float, float, float] | None = None

    def predict(self, calls: DataFrame, samples: DataFrame) -> DataFrame:
        """(sample_idx, covar, geno, pred) of all samples; one without calls keeps its covariates' prediction. geno is on the
        scale of the residuals; a transformed one that can't be put back counts as the median of the others."""
        geno = self.genotypes.predict(calls).withColumnRenamed("pred", "geno")
        if self.scale is not None:
            back = C.inverse_standard(F.col("geno"), self.scale)
            geno = cut(geno.withColumn("geno", F.when(~F.isnan(back), back)))
            middle = geno.agg(F.coalesce(F.percentile_approx("geno", 0.5, 10000), F.lit(0.0)).alias("_m"))
            geno = geno.crossJoin(F.broadcast(middle)).withColumn("geno", F.coalesce("geno", "_m")).drop("_m")  # one row
        both = self.covariates.predict(samples.select("sample_idx", *self.covariates.names)).join(geno, "sample_idx", "left")
        pred = C.fuse(F.col("covar"), F.coalesce("geno", F.lit(0.0)), self.strategy, self.classification)
        return both.select("sample_idx", "covar", "geno", pred.alias("pred"))


def train(calls: DataFrame, samples: DataFrame, names: list[str], config: Config, strategy: str = "residualization") -> Fused:
    """samples (sample_idx, y, split, the covariates and, if it is there, weight). Genotypes learn

    predictive, residualization: plain residuals, or Pearson residuals of classes under `residualization`;
    yeo-johnson: residuals of values, transformed to near normal by an exponent fitted on the training rows and kept;
    offset: the labels themselves, boosted from the covariates' prediction (trees only).

    Out-of-fold predictions stand for the covariates of training rows. Stops and weights of estimators use correlation,
    since residuals aren't classes; weights of samples count for plain residuals and offsets."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}; it is {strategy!r}")
    classes = config.data.classification
    if strategy == "yeo-johnson" and classes:
        raise ValueError("yeo-johnson is for values")
    if strategy == "offset" and not config.model.trees:
        raise ValueError("an offset needs trees")
    more = [c for c in ("weight",) if c in samples.columns and strategy in ("predictive", "offset")]
    rows = samples.where("y is not null").select("sample_idx", F.col("y").cast("double").alias("y"), "split", *names, *more)
    teach = rows.where("split = 'train'")
    model = fit(teach, names, "y", classes)
    known = out_of_fold(teach, names, "y", classes).unionByName(model.predict(rows.where("split <> 'train'")))
    scale = None
    if strategy == "offset":
        on_logit = classes and config.model.class_loss
        given = known.select("sample_idx", "y", "split", *more, (C.logit(F.col("covar")) if on_logit else F.col("covar")).alias("offset"))
        fitted = lifecycle.train(calls, cut(given), Config(replace(config.data, classification=False, scale_labels=False), config.model, replace(config.train, scorer="pearson_corr")), margin=True)
        return Fused(model, fitted, "offset" if on_logit or not classes else "predictive", classes)
    left = C.pearson_residual(F.col("y"), F.col("covar")) if classes and strategy == "residualization" else F.col("y") - F.col("covar")
    residuals = cut(known.select("sample_idx", left.alias("y"), "split", *more))
    if strategy == "yeo-johnson":
        scale = C.transformed_scale(residuals.where("split = 'train'"), "y")
        residuals = residuals.withColumn("y", C.standard_yeo_johnson(F.col("y"), scale))
    plain = Config(replace(config.data, classification=False), replace(config.model, class_loss=False), replace(config.train, scorer="pearson_corr"))
    return Fused(model, lifecycle.train(calls, residuals, plain), strategy, classes, scale)
