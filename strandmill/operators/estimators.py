"""Weak estimators: one group per estimator, fitted in parallel by grouped pandas functions, or MLlib over wide rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def soft(x, t):
    return np.sign(x) * np.maximum(np.abs(x) - t, 0)


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1_ratio: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Coordinate descent for (1/2n)|y - a - xb|^2 + alpha (l1 |b| + (1 - l1)/2 b^2)."""
    n, m = x.shape
    mx, my = x.mean(0), y.mean()
    xc, r = x - mx, y - my
    b, q = np.zeros(m), (xc**2).sum(0) / n
    for _ in range(rounds):
        most = 0.0
        for j in range(m):
            if q[j] == 0:
                continue
            new = soft(xc[:, j] @ r / n + q[j] * b[j], alpha * l1_ratio) / (q[j] + alpha * (1 - l1_ratio))
            if new != b[j]:
                r -= xc[:, j] * (new - b[j])
                most, b[j] = max(most, abs(new - b[j])), new
        if most < 1e-9:
            break
    return b, float(my - mx @ b)


def bayesian_ridge(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Evidence maximisation of the noise and weight precisions."""
    mx, my = x.mean(0), y.mean()
    xc, yc = x - mx, y - my
    u, s, vt = np.linalg.svd(xc, full_matrices=False)
    noise, weight, uy = 1 / (yc.var() + 1e-12), 1.0, u.T @ yc
    for _ in range(rounds):
        b = vt.T @ (s * uy / (s**2 + weight / noise))
        used = (noise * s**2 / (weight + noise * s**2)).sum()
        old, weight = weight, (used + 2e-6) / ((b**2).sum() + 2e-6)
        noise = (len(y) - used + 2e-6) / (((yc - xc @ b) ** 2).sum() + 2e-6)
        if abs(old - weight) < 1e-6 * weight:
            break
    return b, float(my - mx @ b)


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton steps on the L2-penalised log-likelihood; the intercept is free."""
    z = np.column_stack([x, np.ones(len(x))])
    b, reg = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], 1 / c), 1e-9]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(reg), z.T @ (y - p) - reg * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b[:-1], float(b[-1])


def logistic_net(x: np.ndarray, y: np.ndarray, l1: float, l2: float, rounds: int = 3000) -> tuple[np.ndarray, float]:
    """Accelerated proximal steps for the mean logistic loss + l1 |b| + l2/2 |b|^2; the intercept is free."""
    mean, n = x.mean(0), len(y)
    z = np.column_stack([x - mean, np.ones(n)])
    step = 1 / (np.linalg.norm(z, 2) ** 2 / (4 * n) + l2 + 1e-12)
    b = ahead = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(rounds):
        slope = z.T @ (1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30))) - y) / n
        slope[:-1] += l2 * ahead[:-1]
        new = ahead - step * slope
        new[:-1] = soft(new[:-1], step * l1)
        if (ahead - new) @ (new - b) > 0:  # the momentum points uphill: begin it anew
            t = 1.0
        ahead_t = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, moved, b, t = new + (t - 1) / ahead_t * (new - b), np.abs(new - b).max(), new, ahead_t
        if moved < 1e-9:
            break
    return b[:-1], float(b[-1] - mean @ b[:-1])


def sgd_member(x: np.ndarray, y: np.ndarray, penalty: str | None, classes: bool, epochs: int = 30, rate: float = 0.01, alpha: float = 1e-4, seed: int = 22) -> tuple[np.ndarray, float]:
    """Stochastic steps on the squared loss, or the logistic one for classes, with no, an L1, an L2 or a mixed penalty."""
    rng, b, a = np.random.default_rng(seed), np.zeros(x.shape[1]), 0.0
    l1, l2 = {None: (0, 0), "l1": (alpha, 0), "l2": (0, alpha), "elasticnet": (0.15 * alpha, 0.85 * alpha)}[penalty]
    for e in range(epochs):
        step = rate / (1 + 0.1 * e)
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            z = x[rows] @ b + a
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) if classes else z) - y[rows]) / len(rows)
            b = soft(b - step * (x[rows].T @ g + l2 * b), step * l1)
            a -= step * g.sum()
    return b, a


#: Members that fit classes by the logistic loss, by the name of the member that fits values.
OF_CLASSES = {"linear": "logistic_free", "linear_l1": "logistic_l1", "linear_l2": "logistic", "elasticnet": "logistic_elasticnet", "sgd": "sgd_class", "sgd_l1": "sgd_class_l1", "sgd_l2": "sgd_class_l2", "sgd_elasticnet": "sgd_class_elasticnet"}

MODELS = {
    "linear": lambda x, y: elastic_net(x, y, 1e-9, 0.0),
    "linear_l1": lambda x, y: elastic_net(x, y, 0.05, 1.0),
    "linear_l2": lambda x, y: elastic_net(x, y, 1.0 / max(len(y), 1), 0.0),
    "elasticnet": lambda x, y: elastic_net(x, y, 0.05, 0.5),
    "bayesian": bayesian_ridge,
    "sgd": lambda x, y: sgd_member(x, y, "l2", False),
    "sgd_l1": lambda x, y: sgd_member(x, y, "l1", False),
    "sgd_l2": lambda x, y: sgd_member(x, y, "l2", False),
    "sgd_elasticnet": lambda x, y: sgd_member(x, y, "elasticnet", False),
    "logistic": logistic,
    "logistic_free": lambda x, y: logistic(x, y, 1e9),
    "logistic_l1": lambda x, y: logistic_net(x, y, 0.01, 0.0),
    "logistic_elasticnet": lambda x, y: logistic_net(x, y, 0.005, 0.005),
    "sgd_class": lambda x, y: sgd_member(x, y, None, True),
    "sgd_class_l1": lambda x, y: sgd_member(x, y, "l1", True),
    "sgd_class_l2": lambda x, y: sgd_member(x, y, "l2", True),
    "sgd_class_elasticnet": lambda x, y: sgd_member(x, y, "elasticnet", True),
}


def fit_patches(patch: DataFrame, model: str) -> DataFrame:
    """(estimator_idx, variant_idx, coef) from rows (estimator_idx, sample_idx, variant_idx, x, y); variant -1 is the
    intercept. A patch's size is a parameter, so its dense block is bounded; estimators are independent tasks."""
    fit = MODELS[model]

    def run(rows):
        import pandas as pd

        wide = rows.pivot(index="sample_idx", columns="variant_idx", values="x").fillna(0.0).sort_index(axis=1)
        y = rows.drop_duplicates("sample_idx").set_index("sample_idx")["y"].reindex(wide.index)
        b, a = fit(wide.to_numpy(float), y.to_numpy(float))
        return pd.DataFrame({"estimator_idx": int(rows["estimator_idx"].iloc[0]), "variant_idx": [*map(int, wide.columns), -1], "coef": [*b, a]})

    return patch.groupBy("estimator_idx").applyInPandas(run, "estimator_idx int, variant_idx int, coef double")


def fit_blocks(made: DataFrame, variants: dict[int, np.ndarray], x: dict[int, np.ndarray], model: str, most: int = 256 << 20) -> DataFrame:
    """The same from packed blocks, for members that need a whole patch at once (stochastic ones): `most` cells of it at most."""
    fit = MODELS[model]

    def run(rows):
        import pandas as pd

        from .packed import unpacked

        bs = [unpacked(r) for r in rows.sort_values("ids").to_dict("records")]
        e = bs[0].estimator
        if sum(b.codes.size for b in bs) > most:
            raise ValueError(f"{model} needs a patch of at most {most} cells")
        cells = np.concatenate([np.take_along_axis(x[e], b.codes, axis=1)[:, ~b.check] for b in bs], axis=1).T
        b, a = fit(cells, np.concatenate([b.y[~b.check] for b in bs]))
        return pd.DataFrame({"estimator_idx": e, "variant_idx": [*map(int, variants[e]), -1], "coef": [*b, a]})

    return made.groupBy("estimator_idx").applyInPandas(run, "estimator_idx int, variant_idx int, coef double")


def none(members: DataFrame) -> DataFrame:
    """No coefficients."""
    return members.sparkSession.createDataFrame([], "variant_idx int, coef double")


def optimality(patch: DataFrame, coefs: DataFrame, l1: float = 0.0, l2: float | None = 0.0, classes: bool = False, tolerance: float = 1e-4) -> DataFrame:
    """(estimator_idx, n, m, optimal): whether each estimator's coefficients meet the conditions of a minimum of the mean
    loss (squared, or of classes) with penalties l1 |b| and l2 / 2 b^2; l2 of None is 1 / n."""

    def run(rows, own):
        import pandas as pd

        wide = rows.pivot(index="sample_idx", columns="variant_idx", values="x").fillna(0.0).sort_index(axis=1)
        y = rows.drop_duplicates("sample_idx").set_index("sample_idx")["y"].reindex(wide.index).to_numpy(float)
        c, x = own.set_index("variant_idx")["coef"], wide.to_numpy(float)
        b, z = c.reindex(wide.columns).to_numpy(float), wide.to_numpy(float) @ c.reindex(wide.columns).to_numpy(float) + c[-1]
        rest = y - (1 / (1 + np.exp(-z)) if classes else z)
        slope = x.T @ rest / len(y) - (1 / len(y) if l2 is None else l2) * b
        fine = np.where(b == 0, np.abs(slope) <= l1 + tolerance, np.abs(slope - l1 * np.sign(b)) <= tolerance).all() and abs(rest.mean()) <= tolerance
        return pd.DataFrame({"estimator_idx": [int(rows["estimator_idx"].iloc[0])], "n": [len(y)], "m": [x.shape[1]], "optimal": [bool(fine)]})

    return patch.groupBy("estimator_idx").cogroup(coefs.groupBy("estimator_idx")).applyInPandas(run, "estimator_idx int, n long, m long, optimal boolean")


def ensemble_patches(patch: DataFrame, models: list[str]) -> DataFrame:
    """(estimator_idx, member, sample_idx, pred): several base models on the same patch, predicting its samples, and their
    mean as member `mean`. The patch is brought together once for all its members."""
    fits = {m: MODELS[m] for m in models}

    def run(rows):
        import pandas as pd

        wide = rows.pivot(index="sample_idx", columns="variant_idx", values="x").fillna(0.0).sort_index(axis=1)
        y = rows.drop_duplicates("sample_idx").set_index("sample_idx")["y"].reindex(wide.index).to_numpy(float)
        x, out = wide.to_numpy(float), {}
        for name, fit in fits.items():
            b, a = fit(x, y)
            out[name] = x @ b + a
        out["mean"] = np.mean(list(out.values()), axis=0)
        e = int(rows["estimator_idx"].iloc[0])
        return pd.concat([pd.DataFrame({"estimator_idx": e, "member": m, "sample_idx": wide.index, "pred": p}) for m, p in out.items()])

    return patch.groupBy("estimator_idx").applyInPandas(run, "estimator_idx int, member string, sample_idx long, pred double")


def eliminate(patch: DataFrame, keep: int) -> DataFrame:
    """(estimator_idx, variant_idx, ranking): recursive elimination by least squares, the variant with the smallest
    absolute coefficient (the last of equals) going each round; 1 for the `keep` that stay, then 2 for the last to go."""

    def run(rows):
        import pandas as pd

        wide = rows.pivot(index="sample_idx", columns="variant_idx", values="x").fillna(0.0).sort_index(axis=1)
        y = rows.drop_duplicates("sample_idx").set_index("sample_idx")["y"].reindex(wide.index).to_numpy(float)
        x, left, ranking = wide.to_numpy(float), list(range(wide.shape[1])), np.ones(wide.shape[1], dtype=int)
        x = x - x.mean(0)
        while len(left) > keep:
            b = np.abs(np.linalg.lstsq(x[:, left], y - y.mean(), rcond=None)[0])
            gone = left.pop(len(b) - 1 - int(np.argmin(b[::-1])))
            ranking[gone] = len(left) - keep + 2
        return pd.DataFrame({"estimator_idx": int(rows["estimator_idx"].iloc[0]), "variant_idx": list(map(int, wide.columns)), "ranking": ranking})

    return patch.groupBy("estimator_idx").applyInPandas(run, "estimator_idx int, variant_idx int, ranking int")


def boosted(wide: DataFrame, features: str, label: str, **settings):
    """A fitted boosted ensemble, for explain."""
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol=features, labelCol=label, seed=22, **settings).fit(wide)


def fit_trees(wide: DataFrame, features: str, label: str, kind: str, classification: bool = False, weight: str | None = None, **settings) -> DataFrame:
    """Adds prediction by MLlib boosting or a random forest: the value, or the probability of class 1. Settings may name
    a validationIndicatorCol, whose rows stop the boosting early."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    from pyspark.ml.functions import vector_to_array

    make = {"gbt": (R.GBTRegressor, C.GBTClassifier), "random_forest": (R.RandomForestRegressor, C.RandomForestClassifier)}[kind][classification]
    if weight is not None:
        settings["weightCol"] = weight
    got = make(featuresCol=features, labelCol=label, seed=22, **settings).fit(wide).transform(wide)
    return got.withColumn("prediction", vector_to_array("probability")[1]).drop("probability", "rawPrediction") if classification else got


def clusters(wide: DataFrame, features: str, k: int) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    return KMeans(featuresCol=features, predictionCol="cluster", k=k, seed=22).fit(wide).transform(wide)


def components(wide: DataFrame, features: str, k: int) -> DataFrame:
    from pyspark.ml.feature import PCA

    return PCA(k=k, inputCol=features, outputCol="pcs").fit(wide).transform(wide)


def vectors(embeddings: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return embeddings.where(F.col("embedding").isNotNull()).select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
