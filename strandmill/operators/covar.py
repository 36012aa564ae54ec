"""Covariate path: out-of-fold least squares, residuals, offset, fusion; and the scalar functions they use."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def out_of_fold_ols(rows: DataFrame, x: str, y: str, k: int) -> DataFrame:
    """Adds oof: each fold predicted by the line fitted on the other folds, from sums by fold (one small aggregate)."""
    xx, yy = F.col(x), F.col(y)
    s = rows.groupBy("fold").agg(F.count("*").cast("double").alias("n"), F.sum(xx).alias("sx"), F.sum(yy).alias("sy"), F.sum(xx * yy).alias("sxy"), F.sum(xx * xx).alias("sxx"))
    t = s.agg(*[F.sum(c).alias(f"t{c}") for c in ("n", "sx", "sy", "sxy", "sxx")])
    r = s.crossJoin(F.broadcast(t)).select("fold", *[(F.col(f"t{c}") - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx")])
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    lines = r.select("fold", slope.alias("_b"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("_a"))
    return rows.join(F.broadcast(lines), "fold").withColumn("oof", F.col("_a") + F.col("_b") * xx).drop("_a", "_b")


def logit(p: Column, eps: float = 1e-6) -> Column:
    c = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(c / (1 - c))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def pearson_residual(y: Column, p: Column) -> Column:
    return (y - p) / (F.sqrt(p * (1 - p)) + 1e-7)


def inverse_pearson_residual(r: Column, p: Column) -> Column:
    return p + r * (F.sqrt(p * (1 - p)) + 1e-7)


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def inverse_yeo_johnson(z: Column, lam: float) -> Column:
    """The inverse, of values clipped to what the transform can give."""
    if lam < 0:
        z = F.least(z, F.lit(-1 / lam - 1e-8))
    if lam > 2:
        z = F.greatest(z, F.lit(1 / (2 - lam) + 1e-8))
    inside = lambda c: F.when(c > 0, c)
    up = F.expm1(z) if lam == 0 else F.pow(inside(z * lam + 1), F.lit(1 / lam)) - 1
    down = 1 - F.exp(-z) if lam == 2 else 1 - F.pow(inside(1 - (2 - lam) * z), F.lit(1 / (2 - lam)))
    return F.when(z >= 0, up).otherwise(down)


def fit_yeo_johnson(rows: DataFrame, column: str, low: float = -5.0, high: float = 7.0, at_once: int = 13, width: float = 1e-4) -> float:
    """The exponent with the largest likelihood. Each pass over the rows tries `at_once` exponents between the bounds and goes on
    between the neighbours of the best one, until these are `width` apart; 1 where nothing can be told."""
    x = F.col(column).cast("double")
    rows = rows.where(x.isNotNull() & ~F.isnan(x))
    best = 1.0
    while high - low > width:
        grid = [low + (high - low) * i / (at_once - 1) for i in range(at_once)]
        sums = [F.var_pop(yeo_johnson(x, g)).alias(f"v{i}") for i, g in enumerate(grid)]
        r = rows.agg(F.count("*").alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("j"), *sums).first()
        v = {g: r[f"v{i}"] for i, g in enumerate(grid)}
        likely = {g: -r["n"] / 2 * math.log(v[g]) + (g - 1) * r["j"] for g in grid if v[g] is not None and 0 < v[g] < math.inf}
        if not likely:
            return 1.0
        best = max(likely, key=lambda g: (likely[g], -abs(g - 1)))
        step = grid[1] - grid[0]
        low, high = best - step, best + step
    return best


def transformed_scale(rows: DataFrame, column: str, lam: float | None = None) -> tuple[float, float, float]:
    """(exponent, mean, deviation) of the transformed column; the exponent is fitted where none is given."""
    lam = fit_yeo_johnson(rows, column) if lam is None else lam
    z = yeo_johnson(F.col(column).cast("double"), lam)
    got = rows.agg(F.avg(z).alias("m"), F.stddev_pop(z).alias("s")).first()
    return lam, got["m"] or 0.0, got["s"] or 1.0


def standard_yeo_johnson(x: Column, scale: tuple[float, float, float]) -> Column:
    return (yeo_johnson(x, scale[0]) - scale[1]) / scale[2]


def inverse_standard(z: Column, scale: tuple[float, float, float]) -> Column:
    return inverse_yeo_johnson(z * scale[2] + scale[1], scale[0])


def fuse(covar: Column, geno: Column, strategy: str, classification: bool) -> Column:
    """predictive: the sum; residualization: the covariate prediction with the residual put back, clipped for classes; offset:
    the genotypes' margin on top of the covariates' (log odds of classes)."""
    if strategy == "offset" and classification:
        return sigmoid(logit(covar) + geno)
    if strategy in ("predictive", "offset"):
        out = covar + geno
    else:
        out = inverse_pearson_residual(geno, covar) if classification else covar + geno
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)) if classification else out
