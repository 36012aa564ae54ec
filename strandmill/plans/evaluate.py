"""Bootstrap evaluation: the whole training again and again on rows drawn with replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import sampling as P
from . import lifecycle


def bootstrap_scores(calls: DataFrame, samples: DataFrame, config: Config, refits: int = 50, seed: int = 22) -> DataFrame:
    """(refit, score): each refit draws the training rows with replacement, as weights of rows, trains and scores the test
    split. Refits follow one another, each a distributed job; one number of each reaches the driver. Members have to take
    weights (trees and all linear ones but the stochastic). samples: sample_idx, y, split."""
    test = samples.where("split = 'test' and y is not null").select("sample_idx", F.col("y").cast("double").alias("y"))
    rest = samples.where("split <> 'train'").select("sample_idx", "y", "split").withColumn("weight", F.lit(1.0))
    train = samples.where("split = 'train' and y is not null").select("sample_idx", "y", "split", F.col("sample_idx").alias("id"))
    own = calls.join(test.select("sample_idx"), "sample_idx", "left_semi")
    rows = []
    for k in range(refits):
        drawn = P.bootstrap(train, seed + k).select("sample_idx", "y", "split", F.col("multiplicity").cast("double").alias("weight"))
        got = lifecycle.train(calls, drawn.unionByName(rest), config).predict(own).join(test, "sample_idx").withColumn("_all", F.lit(0))
        score = lifecycle._metric(got, config.scorer, "_all").first()
        rows.append((k, float(score["score"]) if score else 0.0))
    return calls.sparkSession.createDataFrame(rows, "refit int, score double")


def spread(scores: DataFrame, column: str = "score") -> DataFrame:
    """(mean, std): of all rows, the deviation that of a population."""
    return scores.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
