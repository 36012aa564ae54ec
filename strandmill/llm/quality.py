"""Quality classifier: a generalised additive model with pairwise interactions.

Features come from the text alone. Each is cut into bins by quantiles; cyclic boosting visits the features in turn
and adds a shallow tree (at most four leaves) on the one feature's bins to its lookup table; then the strongest pairs
are boosted on coarse two-way grids. A score is the logistic of the tables' sum: vectorised bin look-ups and additions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, table, texts_of, tidy

FEATURES = ["log_chars", "symbols", "pipes", "capitals", "digits", "stops", "distinct_words", "repeats", "distinct_lines", "word_length", "short_words", "high_bytes"]
#: At most about so many labelled rows are fitted; they are picked by the hash of doc_id.
MOST_ROWS = 100_000
THRESHOLD = 0.3

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"*$#%&@!^~=+<>{}[]\\/_"
_STOPS = b".,;:?"
_LETTERS = bytes(range(97, 123)) + _UPPER + bytes(range(128, 256))


def features(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each text; empty texts have zeros, and ones for what is distinct."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        n = len(raw)
        left = lambda drop: (n - len(raw.translate(None, drop))) / max(n, 1)
        words, lines = text.split(), text.split("\n")
        k = max(len(words), 1)
        out[i] = (
            np.log1p(n), left(_SYMBOLS), raw.count(b"|") / k, left(_UPPER), left(_DIGITS), left(_STOPS),
            len(set(words)) / k if words else 1.0, sum(map(str.__eq__, words, words[1:])) / k, len(set(lines)) / len(lines),
            len(text) / k, 1 - left(_LETTERS), len(raw.translate(None, bytes(range(128)))) / max(n, 1),
        )
    return out


class AdditiveModel:
    def __init__(self, cuts, tables, pairs, base):
        self.cuts, self.tables, self.pairs, self.base = cuts, tables, pairs, base

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(np.nan_to_num(x))
        z = np.full(len(b), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for i, j, ci, cj, t in self.pairs:
            z += t[ci[b[:, i]], cj[b[:, j]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2, reg: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Leaf values by bin of a Newton tree on one binned feature, split where the gain is largest."""
    out = np.full(len(g), g.sum() / (h.sum() + reg))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl < least / 4) | (hr < least / 4), -np.inf, gl**2 / (hl + reg) + gr**2 / (hr + reg) - g.sum() ** 2 / (h.sum() + reg))
    k = int(np.argmax(gain))
    if gain[k] <= 1e-9:
        return out
    return np.concatenate([_shallow_tree(g[: k + 1], h[: k + 1], depth - 1, reg, least), _shallow_tree(g[k + 1 :], h[k + 1 :], depth - 1, reg, least)])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 200, rate: float = 0.15, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 60) -> AdditiveModel:
    """Cyclic boosting; without rows the score is 0.5, with one class near that class's share."""
    d = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(y):
        return AdditiveModel([np.zeros(0)] * d, [np.zeros(1)] * d, [], 0.0)
    x = np.nan_to_num(x)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(cuts, [np.zeros(len(c) + 1) for c in cuts], [], float(np.log(share / (1 - share))))
    b, z = model.bins(x), np.full(len(y), model.base)
    if 0 < y.sum() < len(y):
        for _ in range(rounds):
            for j in range(d):
                p = 1 / (1 + np.exp(-z))
                m = len(model.tables[j])
                step = rate * _shallow_tree(np.bincount(b[:, j], y - p, m), np.bincount(b[:, j], p * (1 - p), m))
                model.tables[j] += step
                z += step[b[:, j]]
        coarse = [np.minimum((np.arange(len(t)) * pair_bins) // max(len(t), 1), pair_bins - 1) for t in model.tables]
        p = 1 / (1 + np.exp(-z))

        def grid(i, j, values):
            return np.bincount(coarse[i][b[:, i]] * pair_bins + coarse[j][b[:, j]], values, pair_bins**2)

        gains = sorted(((float((grid(i, j, y - p) ** 2 / (grid(i, j, p * (1 - p)) + 1)).sum()), i, j) for i in range(d) for j in range(i + 1, d)), reverse=True)[:pairs]
        grids = {(i, j): np.zeros(pair_bins**2) for _, i, j in gains}
        for _ in range(pair_rounds):
            for (i, j), t in grids.items():
                p = 1 / (1 + np.exp(-z))
                step = rate * grid(i, j, y - p) / (grid(i, j, p * (1 - p)) + 3)
                t += step
                z += step[coarse[i][b[:, i]] * pair_bins + coarse[j][b[:, j]]]
        model.pairs = [(i, j, coarse[i], coarse[j], t.reshape(pair_bins, pair_bins)) for (i, j), t in grids.items()]
    return model


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and features (an array of FEATURES) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = features(texts_of(batch))
            for_each = pa.array(list(x), type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), for_each], ["doc_id", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, features array<double>")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(_d, _y): the distinct labels that aren't held out, null labels and null doc_ids left out. Of more than most_rows
    labels a hash of doc_id keeps about most_rows, so that the frame is small enough to broadcast whatever its input."""
    known = labels.select(F.col("doc_id").alias("_d"), F.col("quality").cast("double").alias("_y")).where("_d is not null and _y is not null").distinct()
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64("_d"), F.lit(1 << 20)) < int((1 << 20) * most_rows / n))
    return known.where(F.crc32(F.col("_d").cast("string").cast("binary")) % 5 != 0)


def train(rows: DataFrame, known: DataFrame) -> AdditiveModel:
    """Fits on (doc_id, features) of the rows that known_labels() names. Of repeated doc_ids the smallest features count,
    so that the fit sees no more rows than labels."""
    both = rows.join(F.broadcast(known), F.col("doc_id") == F.col("_d"))
    got = both.groupBy("doc_id", "_y").agg(F.min("features").alias("features")).toPandas().sort_values(["doc_id", "_y"])
    x = np.array(got["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, got["_y"].to_numpy(dtype=float))


def scored(rows: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score, predicted for rows of (doc_id, features)."""

    @F.pandas_udf("double")
    def score(x):
        import pandas as pd

        return pd.Series(model.score(np.array(x.tolist(), dtype=float).reshape(-1, len(FEATURES))))

    out = rows.select("doc_id", held_out().alias("held_out"), score("features").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every row of documents; see features() for empty texts and train() for missing labels."""
    rows = materialize(with_features(docs), "features")
    return scored(rows, train(rows, known_labels(labels)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, whose score is not below the threshold.

    A light pass over (doc_id, text) fits the model; the second pass scores each text where it stands, so that rows
    are never joined to their scores and repeated or null doc_ids do no harm."""
    small_batches(docs.sparkSession)
    known = known_labels(labels)
    taught = docs.select("doc_id", "text").join(F.broadcast(known.select(F.col("_d").alias("doc_id")).distinct()), "doc_id", "left_semi")
    model = train(with_features(taught), known)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series(model.score(features([t or "" for t in text])), dtype=float)

    return docs.where(score(F.col("text")) >= THRESHOLD)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
