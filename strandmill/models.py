"""Registered queries over fitted models; their rows depend on iterative fits, so they have no SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .config import Config, DataConfig, ModelConfig, TrainConfig
from .operators import density as D
from .operators import estimators as E
from .operators import explain as X
from .operators import sampling as P
from .operators.storage import cut
from .plans import covariates, lifecycle
from .plans import sweep as sweeps
from .sources import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def patch(s, d, label):
    plan = P.patches(V.pheno(s, d).where("split = 'train'"), V.variants_small(s, d), 4, 200, 16, 22)
    on = lambda kind: plan.where(F.col("kind") == kind).select("estimator_idx", F.col("idx").alias(f"_{kind}"))
    x = V.geno(s, d).join(on("sample"), F.col("sample_idx") == F.col("_sample")).join(on("variant").withColumnRenamed("estimator_idx", "_e"), (F.col("variant_idx") == F.col("_variant")) & (F.col("estimator_idx") == F.col("_e")))
    y = V.pheno(s, d).select("sample_idx", F.col(label).cast("double").alias("y"))
    return x.join(y, "sample_idx").select("estimator_idx", "sample_idx", "variant_idx", F.coalesce("dosage", F.lit(1)).cast("double").alias("x"), "y")


def fitted(name, model, label="y_cont"):
    QUERIES[name] = lambda s, d: E.fit_patches(patch(s, d, label), model).withColumn("coef", F.round("coef", 6))


for _name, _model, _label in (("fit_ols", "linear", "y_cont"), ("fit_lasso", "linear_l1", "y_cont"), ("fit_ridge", "linear_l2", "y_cont"), ("fit_elasticnet", "elasticnet", "y_cont"), ("fit_bayesian", "bayesian", "y_cont"), ("fit_sgd", "sgd", "y_cont"), ("fit_logistic", "logistic", "y_bin")):
    fitted(_name, _model, _label)


def _wide(s, d):
    return E.vectors(V.table(s, d, "embeddings")).withColumn("y", F.col("label").cast("double"))


QUERIES["fit_gbt"] = lambda s, d: E.fit_trees(_wide(s, d), "features", "y", "gbt", maxIter=5, maxDepth=3).select("vec_id", F.round("prediction", 6).alias("prediction"))
QUERIES["fit_rf"] = lambda s, d: E.fit_trees(_wide(s, d), "features", "y", "random_forest", numTrees=10, maxDepth=4).select("vec_id", F.round("prediction", 6).alias("prediction"))
QUERIES["kmeans"] = lambda s, d: E.clusters(_wide(s, d), "features", 3).select("vec_id", "cluster")
QUERIES["pca"] = lambda s, d: E.components(_wide(s, d), "features", 2).select("vec_id", F.round(vector_to_array("pcs")[0], 5).alias("pc1"), F.round(vector_to_array("pcs")[1], 5).alias("pc2"))


QUERIES["fs_rfe"] = lambda s, d: E.eliminate(patch(s, d, "y_cont"), 5)


def tree_shap_local(s, d):
    wide = _wide(s, d)
    return X.local_shap(wide, "vec_id", "features", E.boosted(wide, "features", "y", maxIter=5, maxDepth=3)).withColumn("phi", F.round("phi", 6))


def tree_interactions(s, d):
    wide = _wide(s, d)
    return X.interactions(wide, "features", E.boosted(wide, "features", "y", maxIter=5, maxDepth=3)).withColumn("interact_values", F.round("interact_values", 6))


def train_predict(s, d):
    """Training on the train split, stop on val, weights from the test split's first half; linear scores of all samples."""
    half = F.when(F.col("split") != "test", F.col("split")).when(F.col("sample_idx") % 2 == 0, "agg").otherwise("test")
    samples = V.pheno(s, d).select("sample_idx", F.col("y_cont").alias("y"), half.alias("split"))
    c = Config(DataConfig(False, 0.05, 0.05, 200, 16), ModelConfig("linear_l2", 8, "geq-average", "loss-weighted-average"), TrainConfig(2, 2))
    return lifecycle.train(V.geno(s, d), samples, c).predict(V.geno(s, d)).withColumn("pred", F.round("pred", 6))


def dbscan(s, d):
    plane = V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return D.dbscan(plane, 0.02, 5)


QUERIES["fit_gbt_class"] = lambda s, d: E.fit_trees(_classes(s, d), "features", "y", "gbt", True, maxIter=5, maxDepth=3).select("vec_id", F.round("prediction", 6).alias("prediction"))
QUERIES["fit_rf_class"] = lambda s, d: E.fit_trees(_classes(s, d), "features", "y", "random_forest", True, numTrees=10, maxDepth=4).select("vec_id", F.round("prediction", 6).alias("prediction"))


def _classes(s, d):
    return _wide(s, d).withColumn("y", (F.col("label") >= 5).cast("double"))


def forest_shap_local(s, d):
    """Interventional values of a boosted ensemble against a background of 500 rows."""
    wide = _wide(s, d)
    leaves = X.leaves_of(E.boosted(wide, "features", "y", maxIter=5, maxDepth=3))
    background = X.background_rows(wide, "features", "vec_id")
    return X.local_values(wide, "vec_id", "features", lambda x: X.interventional_shap(leaves, x, background)).withColumn("phi", F.round("phi", 6))


def kernel_shap_local(s, d):
    """All 64 features, by 512 pairs of sampled coalitions against a background of 20 rows."""
    wide = _wide(s, d)
    leaves = X.leaves_of(E.boosted(wide, "features", "y", maxIter=3, maxDepth=3))
    background = X.background_rows(wide, "features", "vec_id", 20)
    return X.leaf_kernel_values(wide, "vec_id", "features", leaves, background, 512).withColumn("phi", F.round("phi", 6))


def covariate_train_predict(s, d):
    """Covariates age, sex and pc1, then genotypes on Pearson residuals of the classes."""
    samples = V.pheno(s, d).withColumn("y", F.col("y_bin"))
    c = Config(DataConfig(True, 0.05, 0.05, 200, 16), ModelConfig("linear_l2", 4))
    got = covariates.train(V.geno(s, d), samples, ["age", "sex", "pc1"], c).predict(V.geno(s, d), samples)
    return got.select("sample_idx", *[F.round(n, 6).alias(n) for n in ("covar", "geno", "pred")])


def sweep(s, d):
    samples = V.pheno(s, d).select("sample_idx", F.col("y_cont").alias("y"), "split")
    c = Config(DataConfig(False, 0.05, 0.05, 200, 16), ModelConfig("linear_l2", 4))
    return sweeps.sweep(V.geno(s, d), samples, c, {"model_name": ["linear_l1", "linear_l2"], "n_estimators": [2, 4]}, 3).withColumn("score", F.round("score", 6))


QUERIES |= {"forest_shap_local": forest_shap_local, "kernel_shap_local": kernel_shap_local, "covariate_train_predict": covariate_train_predict, "sweep": sweep}
QUERIES |= {"tree_shap_local": tree_shap_local, "tree_interactions": tree_interactions, "train_predict": train_predict, "dbscan": dbscan}
ORACLES["dbscan"] = """with recursive p as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y from embeddings),
  near as (select a.id, b.id as other from p a, p b where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.02::double * 0.02::double),
  counts as (select id, count(*) as n_near from near group by 1), cores as (select id from counts where n_near >= 5),
  edges as (select id, other from near where id in (select id from cores) and other in (select id from cores)),
  reach as (select id, id as c from cores union select r.id, e.other as c from reach r join edges e on r.c = e.id),
  named as (select id, min(c) as cluster from reach group by 1),
  border as (select near.id, min(cluster) as b from near join named on near.other = named.id group by 1)
  select p.id, n_near, cluster is not null as core, coalesce(cluster, b) as cluster from p join counts using (id) left join named using (id) left join border using (id)"""


#: Fitted members meet the conditions of their loss's minimum; the patches' sizes come from the tables.
PATCHES = f"with {V.SQL['pheno']} select e::int as estimator_idx, least(200, (select count(*) from pheno where split = 'train')) as n, 16::bigint as m, true as optimal from range(0, 4) t(e)"


def optimal(name, model, label="y_cont", **penalties):
    def run(s, d):
        own = cut(patch(s, d, label))
        return E.optimality(own, E.fit_patches(own, model), **penalties)

    QUERIES[name], ORACLES[name] = run, PATCHES


optimal("fit_ols_optimal", "linear")
optimal("fit_ridge_optimal", "linear_l2", l2=None)
optimal("fit_lasso_optimal", "linear_l1", l1=0.05)
optimal("fit_elasticnet_optimal", "elasticnet", l1=0.025, l2=0.025)
optimal("fit_logistic_optimal", "logistic", "y_bin", l2=None, classes=True)
optimal("fit_logistic_l1_optimal", "logistic_l1", "y_bin", l1=0.01, classes=True)


def tree_shap_additive(s, d):
    """Local values of a boosted ensemble sum up to its prediction, but for one constant."""
    wide = _wide(s, d)
    fit = E.boosted(wide, "features", "y", maxIter=5, maxDepth=3)
    sums = X.local_shap(wide, "vec_id", "features", fit).groupBy("vec_id").agg(F.sum("phi").alias("_s"))
    rest = fit.transform(wide).select("vec_id", "prediction").join(sums, "vec_id").withColumn("_r", F.col("prediction") - F.col("_s"))
    return rest.agg(F.count("*").alias("n"), (F.max("_r") - F.min("_r") < 1e-6).alias("additive"))


QUERIES["tree_shap_additive"] = tree_shap_additive
ORACLES["tree_shap_additive"] = "select count(*) as n, true as additive from embeddings where embedding is not null"
