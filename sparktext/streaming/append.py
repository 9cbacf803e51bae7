"""Streams of documents into a saved corpus: each micro-batch adds one segment, and searches read the
segments that are there. A batch that runs again replaces its own segment, so nothing counts twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import search as ops
from ..plans.regex import Matcher
from ..sources.corpus import Corpus


def append_stream(stream: DataFrame, path: str, checkpoint: str, text: str = "text", key: str = "doc_id") -> StreamingQuery:
    """Write a stream's documents as segments below ``path``; stops when the source is read up."""

    def add(batch: DataFrame, number: int) -> None:
        batch.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).write.mode("overwrite").parquet(f"{path}/segment={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def corpus_of(spark: SparkSession, path: str, sep: bytes | str = b"\n") -> Corpus:
    """The corpus of all segments, in the order of doc_id."""
    return Corpus.from_df(spark.read.parquet(path), sep=sep)


def running_counts(stream: DataFrame, matcher: Matcher, text: str = "text") -> DataFrame:
    """One growing row: matches within the documents of a stream so far."""
    from ..functions.byteview import view

    n = F.regexp_count(view(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")), F.lit(matcher.ahead))
    return stream.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.count("*").alias("docs"))
