"""What a run leaves behind: annotated variants, interactions, models, predictions and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lifecycle import Fitted

PARTS = ("stats", "members", "weights", "coefs")


def annotations(variants: DataFrame, stats: DataFrame, shap: DataFrame, coefs: DataFrame | None = None) -> DataFrame:
    """Every variant with its statistics and Shapley values (variant_idx, shap_values, shap_values_abs), null where it has
    none; with coefficients also effect_weight and effect_type."""
    out = variants.join(stats, "variant_idx", "left").join(shap, "variant_idx", "left")
    if coefs is not None:
        weight = coefs.where("variant_idx >= 0").select("variant_idx", F.col("coef").alias("effect_weight"))
        out = out.join(weight, "variant_idx", "left").withColumn("effect_type", F.when(F.col("effect_weight").isNotNull(), "additive"))
    return out


def named_interactions(edges: DataFrame, variants: DataFrame) -> DataFrame:
    """Edges (variant_i, variant_j, interact_values) with i < j, with chr and pos of both ends."""
    out = edges.where("variant_i < variant_j and interact_values <> 0")
    for end in ("i", "j"):
        place = variants.select(F.col("variant_idx").alias(f"variant_{end}"), F.col("chr").alias(f"chr_{end}"), F.col("pos").alias(f"pos_{end}"))
        out = out.join(place, f"variant_{end}", "left")
    return out


def by_type(out: DataFrame, values: DataFrame, types: list[str]) -> DataFrame:
    """Adds shap_<type> and shap_abs_<type> of each model type from values (variant_idx, model_type, value, value_abs)."""
    wide = values.groupBy("variant_idx").pivot("model_type", types).agg(F.first("value").alias("v"), F.first("value_abs").alias("a"))
    named = wide.select("variant_idx", *[c for t in types for c in (F.col(f"`{t}_v`").alias(f"shap_{t}"), F.col(f"`{t}_a`").alias(f"shap_abs_{t}"))])
    return out.join(named, "variant_idx", "left")


def save_annotations(path: str, variants: DataFrame, stats: DataFrame, shap: DataFrame, coefs: DataFrame | None = None, values: DataFrame | None = None, types: list[str] | None = None, edges: DataFrame | None = None) -> None:
    """Writes path/annotations, with the columns of each model type where their values are given, and path/interactions where
    edges are."""
    out = annotations(variants, stats, shap, coefs)
    if values is not None:
        out = by_type(out, values, types or [])
    out.write.mode("overwrite").parquet(f"{path}/annotations")
    if edges is not None:
        named_interactions(edges, variants).write.mode("overwrite").parquet(f"{path}/interactions")


def save_model(fitted: Fitted, path: str) -> None:
    for part in PARTS:
        getattr(fitted, part).write.mode("overwrite").parquet(f"{path}/{part}")


def load_model(spark: SparkSession, path: str) -> Fitted:
    return Fitted(**{part: spark.read.parquet(f"{path}/{part}") for part in PARTS})


def save_run(predictions: DataFrame, path: str, **metadata) -> None:
    """Predictions as Parquet and one JSON row of metadata beside them."""
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    one = predictions.sparkSession.range(1)
    one.select(*[F.lit(v).alias(k) for k, v in metadata.items()]).write.mode("overwrite").json(f"{path}/metadata")
