"""The corpus pipeline: each stage works on all that the one before kept and returns documents; the
last returns the encoded corpus.

Order: quality classifier, near-duplicate removal, repeated passages, benchmark decontamination,
byte-level BPE. Stages are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparktext.llm import bpe, decontam, quality, simhash, suffixdedup
from sparktext.llm._common import drop_tables, read, table, tables
from sparktext.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labelled ones, expects to be good."""
    model = quality.train(docs, quality.graded(read(spark, sf_dir, "labels")))
    return quality.select(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return simhash.deduplicate(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return suffixdedup.remove(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; items shorter than a window count where they
    make up half of the document."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"), short_share=0.5)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of ids and decoded bytes."""
    return bpe.round_trip(docs, vocabulary(), with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", passage_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: SQL has neither the classifier nor the fuzzy hashing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is a written table."""
    docs, before = read(spark, sf_dir, "documents"), tables(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = table(stage(spark, docs, sf_dir), f"stage{k}")
        drop_tables(spark, before)  # what the stage has written on its way, and its input
    return docs
