"""Lost token files, and the quality model on the given labels and against plain loops."""

import glob
import os

import numpy as np
import pytest

pytest.importorskip("strandmill.llm")
from pyspark.sql import functions as F

from strandmill.llm import common, quality, token_files

DIR = "/root/testdata/sf0.01"


def test_a_lost_file_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string")
    folder = f"file://{tmp_path}/files"
    index = token_files.write(docs, "word_bpe_49k.json", folder)
    assert token_files.read(spark, folder, index).count() == 20
    os.remove(sorted(glob.glob(f"{tmp_path}/files/*.rvb"))[0])
    with pytest.raises(FileNotFoundError, match="are missing"):
        token_files.read(spark, folder, index)


def area(score, label):
    order = np.argsort(score)
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        ranks[score == v] = ranks[score == v].mean()
    p = label.sum()
    return (ranks[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


def test_held_out_labels(spark):
    got = quality.op10_quality(spark, DIR).join(common.table(spark, DIR, "labels").where("quality is not null").select("doc_id", "quality"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(held) > 20 and held["quality"].nunique() == 2
    assert area(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.85
    assert (held["predicted"] == held["quality"]).mean() > 0.8


def test_scores_are_sums_of_bins():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = ((x[:, 0] * x[:, 1] + x[:, 2]) > 0).astype(float)
    m = quality.fit(x, y, rounds=20, pair_rounds=10)
    want = []
    for row in x:
        at = [int(np.searchsorted(c, v, side="right")) for c, v in zip(m.cuts, row)]
        other = [int(np.searchsorted(c, v, side="left")) for c, v in zip(m.cuts, row)]
        assert at == other  # no value is on a cut
        z = m.base + sum(t[k] for t, k in zip(m.tables, at)) + sum(t[a[at[i]], b[at[j]]] for i, j, a, b, t in m.pairs)
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(m.score(x), want)
