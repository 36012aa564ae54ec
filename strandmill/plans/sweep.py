"""Random search over configurations, scored on the validation split."""

from __future__ import annotations

import json
import random
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, override
from . import lifecycle

FORM = "trial int, settings string, score double"


def settings(grid: dict[str, list], trials: int, seed: int) -> list[dict]:
    """Different settings of the grid in a seeded random order, all of them when there are no more than `trials`."""
    every = [dict(zip(sorted(grid), values)) for values in product(*(grid[k] for k in sorted(grid)))]
    random.Random(seed).shuffle(every)
    return every[:trials]


def sweep(calls: DataFrame, samples: DataFrame, config: Config, grid: dict[str, list], trials: int = 50, seed: int = 22) -> DataFrame:
    """(trial, settings, score): a training for each setting. Trials follow one another, each a distributed job; one number
    of each reaches the driver. A trial that scores nothing (no labels) has a score of 0."""
    val = samples.where("split = 'val' and y is not null").select("sample_idx", F.col("y").cast("double").alias("y"))
    rows = []
    for i, chosen in enumerate(settings(grid, trials, seed)):
        c = override(config, **chosen)
        got = lifecycle.train(calls, samples, c).predict(calls.join(val.select("sample_idx"), "sample_idx", "left_semi")).join(val, "sample_idx")
        score = lifecycle._metric(got.withColumn("_all", F.lit(0)), c.scorer, "_all").first()
        rows.append((i, json.dumps(chosen, sort_keys=True), float(score["score"]) if score else 0.0))
    return calls.sparkSession.createDataFrame(rows, FORM)
