"""Corpora: ordered documents as one byte string.

A corpus is a DataFrame (doc_id, ord, body, tail, byte_len, start): ``tail`` are the bytes after a
document (the separator; the sentinel 0 after the last one), ``start`` its place in the whole. Starts
are prefix sums in two levels: per group of neighbouring ``ord`` values, then over the groups, so no
window runs over all documents in one task.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import bound_batches
from ..functions.byteview import view

#: Neighbouring documents whose starts are summed in one task.
GROUP = 1 << 16

#: Bytes that are counted at a time.
STEP = 1 << 20


class Corpus:
    """Documents in the order of ``ord``, joined by a separator and ended by the sentinel byte 0."""

    def __init__(self, rows: DataFrame, sep: bytes = b"\n"):
        """rows: doc_id, ord (long, distinct), body (binary, without byte 0), tail (binary)."""
        self.sep = sep
        clean = F.when(F.locate("\0", view("body")) > 0, F.raise_error(F.lit("a text has the byte 0"))).otherwise(F.col("body"))
        self.rows = rows.select("doc_id", "ord", clean.alias("body"), "tail")

    @classmethod
    def from_df(cls, df: DataFrame, text: str = "text", key: str = "doc_id", sep: bytes | str = b"\n") -> Corpus:
        """One document a row, in the order of an integer key; null texts are empty. Keys must be distinct and
        not null for anything that has positions (an error if not); counts take rows as they are."""
        sep = sep.encode() if isinstance(sep, str) else sep
        if b"\0" in sep:
            raise ValueError("separator must not contain 0x00 (sentinel byte)")
        body = F.col(text) if dict(df.dtypes)[text] == "binary" else F.encode(text, "UTF-8")
        last = df.agg(F.max(F.col(key).cast("long")).alias("last"))
        rows = df.select(F.col(key).alias("doc_id"), F.col(key).cast("long").alias("ord"), F.coalesce(body, F.lit(b"")).alias("body")).crossJoin(F.broadcast(last))  # one row
        return cls(rows.withColumn("tail", F.when(F.col("ord") == F.col("last"), F.lit(b"\0")).otherwise(F.lit(sep))), sep)

    @classmethod
    def from_texts(cls, spark: SparkSession, texts: list[bytes | str], sep: bytes | str = b"\n") -> Corpus:
        """Texts held in memory; no text at all is the empty text."""
        rows = [(k, bytearray(t.encode() if isinstance(t, str) else t)) for k, t in enumerate(texts or [b""])]
        return cls.from_df(spark.createDataFrame(rows, "doc_id long, text binary"), sep=sep)

    @classmethod
    def from_files(cls, spark: SparkSession, *paths: str, extensions: tuple[str, ...] = (), sep: bytes | str = b"\n") -> Corpus:
        """Whole files as bytes: given files in the order given, folders with all below them by path."""
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if extensions:
            reader = reader.option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}")
        parts = [reader.load(p).select(F.lit(k).alias("k"), "path", F.col("content").alias("text")) for k, p in enumerate(paths)]
        files = functools.reduce(DataFrame.unionAll, parts)
        # names only are numbered in one task, not contents
        numbered = files.select("k", "path").withColumn("doc_id", F.row_number().over(Window.orderBy("k", "path")).cast("long") - 1)
        return cls.from_df(files.join(numbered, ["k", "path"]), sep=sep)

    def append(self, df: DataFrame, text: str = "text", key: str = "doc_id") -> Corpus:
        """The corpus with more text right after its end (no separator between old and new)."""
        more = Corpus.from_df(df, text, key, self.sep).rows
        top = self.rows.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top"))
        low = more.agg(F.min("ord").alias("low"))
        moved = more.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(low)).withColumn("ord", F.col("ord") - F.col("low") + F.col("top") + 1).select("doc_id", "ord", "body", "tail")
        some = low.select(F.col("low").isNotNull().alias("some"))
        old = self.rows.crossJoin(F.broadcast(some)).withColumn("tail", F.when((F.col("tail") == F.lit(b"\0")) & F.col("some"), F.lit(b"")).otherwise(F.col("tail"))).select("doc_id", "ord", "body", "tail")
        return Corpus(old.unionAll(moved), self.sep)

    @functools.cached_property
    def df(self) -> DataFrame:
        """doc_id, ord, body, tail, byte_len, start."""
        known = F.coalesce("ord", F.raise_error(F.lit("keys of documents must be distinct and not null")).cast("long"))
        sized = self.rows.withColumn("ord", known).withColumn("byte_len", F.octet_length("body").cast("long")).withColumn("span", F.col("byte_len") + F.octet_length("tail"))
        narrow = sized.select("ord", "span").withColumn("g", F.floor(F.col("ord") / GROUP))
        groups = narrow.groupBy("g").agg(F.sum("span").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        order = Window.partitionBy("g").orderBy("ord")
        # equal keys have no order, and texts would be joined to the wrong starts
        wrong = F.coalesce(F.lag("ord").over(order) == F.col("ord"), F.lit(False))
        before = F.when(wrong, F.raise_error(F.lit("keys of documents must be distinct and not null"))).otherwise(F.coalesce(F.sum("span").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        starts = narrow.withColumn("before", before).join(groups.select("g", "base"), "g").select("ord", (F.col("before") + F.col("base")).alias("start"))
        return sized.join(starts, "ord").select("doc_id", "ord", "body", "tail", "byte_len", "start")

    def stats(self) -> DataFrame:
        """docs, text_len, sa_len (one more, for the sentinel)."""
        n = F.coalesce(F.sum(F.octet_length("body") + F.octet_length("tail")), F.lit(0)).cast("long")
        return self.rows.agg(F.count("*").alias("docs"), (n - 1).alias("text_len"), n.alias("sa_len"))

    def offsets(self) -> DataFrame:
        return self.df.select("doc_id", "start", "byte_len")

    def byte_histogram(self) -> DataFrame:
        """byte, n: counts of all bytes, separators and the sentinel included."""
        bound_batches(self.rows.sparkSession)

        def count(batches):
            for b in batches:
                # a batch's values lie one after the other in its buffer
                total = np.zeros(256, np.int64)
                for column in b.columns:
                    flat = column.cast(pa.large_binary())
                    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
                    if len(flat) and flat.buffers()[2] is not None:
                        for lo in range(int(offsets[0]), int(offsets[-1]), STEP):  # NumPy counts on a copy of eight bytes a byte
                            total += np.bincount(np.frombuffer(flat.buffers()[2], np.uint8)[lo : min(lo + STEP, int(offsets[-1]))], minlength=256)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["byte", "n"])

        return self.rows.select("body", "tail").mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))

    def alphabet_size(self) -> DataFrame:
        return self.byte_histogram().agg(F.count("*").alias("alphabet_size"))

    def c_array(self) -> DataFrame:
        """byte, c: bytes of the corpus below each of its bytes."""
        before = Window.orderBy("byte").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
        return self.byte_histogram().select("byte", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("c"))

    def reversed(self) -> Corpus:
        """The mirror image: documents from last to first, each reversed (one sentinel at the end)."""
        # separators stand before a document's mirror, so they follow the mirror of the next one
        nxt = self.rows.select((-F.col("ord")).alias("ord"), "doc_id", F.encode(F.reverse(view("body")), "ISO-8859-1").alias("body"), "tail")
        w = Window.orderBy("ord")
        tails = nxt.select("ord", F.coalesce(F.lead("tail").over(w), F.lit(b"\0")).alias("t"))
        return Corpus(nxt.drop("tail").join(tails, "ord").select("doc_id", "ord", "body", F.encode(F.reverse(view("t")), "ISO-8859-1").alias("tail")), self.sep[::-1])
