"""Finding strings that recur across a corpus: sampled anchors, and which of them are met twice.

A window of ``width`` units (bytes or words) is found through the grams of ``gram`` units in it: the
one with the smallest hash is its anchor. Equal windows have the same anchor at the same place, so a
window that recurs has an anchor that recurs. Only anchors (one in about (width - gram + 2) / 2 units)
are shuffled: as (hash, doc_id), counted with a partial aggregation, and those met at least twice are
joined back to their documents. No text, pair or window takes part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_tables, map_chunks, mix, release, table, tables

#: An anchor met more often than this is spread by whole windows instead of by its hash.
HOT = 100_000


def _slide(x: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each run of ``size`` values."""
    have = 1
    while have * 2 <= size:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: -(size - have)], x[size - have :]) if size > have else x


def gram_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of each run of ``size`` units, a power of two (units: uint64)."""
    h, have = mix(units + np.uint64(0x9E3779B97F4A7C15)), 1
    while have < size:
        h = mix(h[:-have] * np.uint64(0xD6E8FEB86659FD93) + h[have:])
        have *= 2
    return h


def order_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """32-bit hashes of each run of ``size`` units, a power of two, for choosing anchors only."""
    h, have = units.astype(np.uint32) * np.uint32(2654435761) + np.uint32(1), 1
    while have < size:
        h = h[:-have] * np.uint32(0x9E3779B1) + (h[have:] ^ (h[have:] >> np.uint32(15)))
        h ^= h >> np.uint32(13)
        have *= 2
    return (h * np.uint32(0x85EBCA6B)) | np.uint32(1)


class Anchors:
    """Anchors of a chunk of documents, whose units lie one after the other."""

    def __init__(self, units: np.ndarray, ends: np.ndarray, width: int, gram: int, only: np.ndarray | None = None):
        """ends: where each document ends in ``units``; only: the places of grams that may be anchors (all).

        A window's anchor is the same whichever other grams may be one, if its own is among them.
        """
        self.width, self.gram = width, gram
        n = len(units)
        self.at = np.zeros(0, np.int64)
        if n < width:
            return
        h = order_hashes(units, gram)
        if only is not None:
            some, h = h, np.full(len(h), np.iinfo(np.uint32).max, np.uint32)
            h[only] = np.minimum(some[only], h[0] - np.uint32(2))
        low = _slide(h, width - gram + 1, np.minimum)
        # windows that run over the end of a document are none
        start = np.concatenate([[0], ends[:-1]])
        cross = np.zeros(len(low) + 1, np.int32)
        a = np.minimum(np.maximum(ends - width + 1, start), len(low))
        np.add.at(cross, a, 1)
        np.add.at(cross, np.minimum(ends, len(low)), -1)
        low[np.cumsum(cross[:-1]) > 0] = 0
        self.low, self.h = low, h
        if only is not None:
            self.at = only
            return
        pad = np.zeros(width - gram, np.uint32)
        high = _slide(np.concatenate([pad, low, pad]), width - gram + 1, np.maximum)
        self.at = np.flatnonzero(h == high)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For anchors at these places: least and most units before the anchor in the windows it is
        the anchor of; most < least if there is none."""
        span = self.width - self.gram + 1
        least, most = np.full(len(at), span), np.full(len(at), -1)
        for back in range(span):
            s = at - back
            ok = (s >= 0) & (s < len(self.low))
            ok[ok] = self.low[s[ok]] == self.h[at[ok]]
            np.minimum(least, np.where(ok, back, span), out=least)
            np.maximum(most, np.where(ok, back, -1), out=most)
        return least, most


def copies(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id of each document whose text an earlier doc_id has too: (doc_id), distinct."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha")).where("doc_id is not null and sha is not null")
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("low"))
    return rows.join(first, "sha").where("doc_id > low").select("doc_id").distinct()


def recurring(docs: DataFrame, anchors_of, text: str, key: str, hot: int = HOT) -> DataFrame:
    """doc_id, hs: the hashes of its anchors that are met at least twice in the corpus, and hot: those
    of them met more than ``hot`` times.

    anchors_of: from a list of texts (bytes) to (index of the text, 64-bit hash) of all anchors.
    """

    def run(cols):
        use = [k for k, t in enumerate(cols[1]) if t is not None and cols[0][k] is not None]
        row, h = anchors_of([cols[1][k] for k in use])
        ids = np.array([cols[0][k] for k in use], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[row] if len(ids) else ids)], names=["h", "doc_id"])

    before = tables(docs.sparkSession)
    met = table(map_chunks(docs.select(F.col(key).cast("long"), F.encode(text, "UTF-8")), run, "h long, doc_id long"), "anchors")
    # joined by another name of ``h``: counts are shuffled anew, so that Spark may split a frequent anchor's rows over tasks
    again = met.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.bitwise_not("h").alias("k"), "n")
    lists = met.withColumn("k", F.bitwise_not("h")).join(again, "k").groupBy("doc_id").agg(F.collect_set("h").alias("hs"), F.collect_set(F.when(F.col("n") > hot, F.col("h"))).alias("hot"))
    out = table(lists, "recurring")
    drop_tables(docs.sparkSession, before)  # the anchors
    release(docs.sparkSession)
    return out


def frequent(going: DataFrame, hot: int) -> DataFrame | None:
    """h: names met more than ``hot`` times (a hundred-thousandth of the rows at most); None if there are none."""
    many = table(going.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h"), "frequent")
    return None if many.isEmpty() else many


def spans_of(marks: DataFrame) -> DataFrame:
    """doc_id, starts, ends: all marked ranges of a document."""
    return marks.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("marks"))


def merged(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges joined where they overlap or touch, cut to ``size``."""
    if not len(starts):
        return starts, ends
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, np.minimum(starts, size), 1)
    np.add.at(edge, np.minimum(ends, size), -1)
    on = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    flips = np.flatnonzero(np.diff(on.view(np.int8)))
    return flips[::2], flips[1::2]
