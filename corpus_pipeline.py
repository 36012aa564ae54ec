"""The corpus pipeline: quality classifier, near-dedup, mixing, BPE encoding and decoding, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import bpe, common, minhash, mixing, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; all columns stay."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order; documents that it doesn't take go."""
    return mixing.training_copies(docs, docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the text that the ids decode to, of every row."""
    return bpe.encode(docs, "word_bpe_49k.json", ["doc_id", "source"], back=True)


STAGES = [("quality", keep_quality), ("near_dedup", dedup), ("mixing", mix_sources), ("bpe", encode)]

#: SQL can't express the classifier, the sketch or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
