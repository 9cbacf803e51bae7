"""Suffix arrays, Burrows-Wheeler transform, runs and LF mapping, per shard.

A shard is one byte string; its suffixes (the sentinel's own included) are sorted by a NumPy kernel in
one Arrow task per shard, and everything else is windows over the table (shard, rank, pos, bwt).
Small corpora are one shard, which is the textbook index; large ones are a shard per document
or per group of documents, and ranks are within the shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import bound_batches
from ..functions.byteview import view
from ..sources.corpus import Corpus

#: Bytes of a corpus that may become one shard.
MAX_SHARD = 64 << 20


def by_doubling(data: bytes) -> np.ndarray:
    """Sorted suffix starts of ``data`` followed by a sentinel below all bytes: sorted by the first seven
    bytes, then groups that are still equal by the ranks of what follows, twice as far each round."""
    n = len(data) + 1
    s = np.zeros(n + 7, np.uint64)
    s[: n - 1] = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    # seven characters of 9 bits each fit one integer
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | s[k : k + n]
    order = np.argsort(key)  # equal keys get one rank, so their order is free
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    at = np.flatnonzero(~(first & np.append(first[1:], True)))  # places in groups of two or more
    gap = 7
    while len(at):
        idx = order[at]
        own, after = rank[idx], idx + gap
        nxt = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.argsort(own * (n + 1) + nxt + 1)
        idx, own, nxt = idx[by], own[by], nxt[by]
        order[at] = idx
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])])
        rank[idx] = np.maximum.accumulate(np.where(first, at, 0))
        at = at[~(first & np.append(first[1:], True))]
        gap *= 2
    return order


def by_induced_sorting(data: bytes) -> np.ndarray:
    """The same by induced sorting (linear steps): suffixes that start a run of smaller-type
    characters are named and sorted, recursively, and the others follow from them."""

    def sort(s: list[int], size: int) -> list[int]:
        n = len(s)
        small = [True] * n  # suffix smaller than the next one
        for k in range(n - 2, -1, -1):
            small[k] = s[k] < s[k + 1] or (s[k] == s[k + 1] and small[k + 1])
        left = [k for k in range(1, n) if small[k] and not small[k - 1]]
        counts = np.bincount(s, minlength=size)
        ends = np.cumsum(counts)

        def induce(marked: list[int]) -> list[int]:
            sa = [-1] * n
            tail = ends.tolist()
            for k in reversed(marked):
                tail[s[k]] -= 1
                sa[tail[s[k]]] = k
            head = (ends - counts).tolist()
            for k in range(n):
                j = sa[k] - 1
                if j >= 0 and not small[j]:
                    sa[head[s[j]]] = j
                    head[s[j]] += 1
            tail = ends.tolist()
            for k in range(n - 1, -1, -1):
                j = sa[k] - 1
                if j >= 0 and small[j]:
                    tail[s[j]] -= 1
                    sa[tail[s[j]]] = j
            return sa

        sa = induce(left)
        is_left = set(left)
        order = [k for k in sa if k in is_left]
        stop = dict(zip(left, left[1:] + [n - 1]))
        name, names, before = -1, {}, None
        for k in order:
            part = s[k : stop[k] + 1]
            if part != before:
                name += 1
            names[k], before = name, part
        reduced = [names[k] for k in left]
        if name + 1 < len(left):
            sub = sort(reduced, name + 1)
        else:
            sub = [0] * len(left)
            for k, x in enumerate(reduced):
                sub[x] = k
        return induce([left[k] for k in sub])

    if not data:
        return np.zeros(1, np.int64)
    return np.array(sort([b + 1 for b in data] + [0], 257), np.int64)


KERNELS = {"doubling": by_doubling, "sais": by_doubling, "sais-reference": by_induced_sorting}


def suffix_table(texts: DataFrame, shard: str = "doc_id", body: str = "body", algorithm: str = "sais") -> DataFrame:
    """shard, rank, pos, bwt (0: sentinel) of each row's byte string. One task holds one shard at a time."""
    kernel = KERNELS[algorithm]

    def batch(held):
        keys, cols = [x[0] for x in held], [np.concatenate(c) for c in zip(*(x[1:] for x in held))]
        index = pa.array(np.repeat(np.arange(len(keys)), [len(x[1]) for x in held]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()).take(index), *map(pa.array, cols)], names=["shard", "rank", "pos", "bwt"])

    def run(batches):
        # short shards go out together, long ones in parts
        held, size = [], 0
        for b in batches:
            for key, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = value or b""
                sa = kernel(data)
                bytes_ = np.append(np.frombuffer(data, np.uint8), 0).astype(np.int16)
                bwt = bytes_[sa - 1]
                for k in range(0, len(sa), 1 << 18):
                    part = slice(k, k + (1 << 18))
                    held.append((key, np.arange(k, k + len(sa[part])), sa[part], bwt[part]))
                    size += len(sa[part])
                    if size >= 1 << 18:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    rows = texts.select(F.col(shard).cast("long").alias("shard"), F.col(body).alias("body"))
    return rows.mapInArrow(run, "shard long, rank long, pos long, bwt short")


def summaries(texts: DataFrame, shard: str = "doc_id", body: str = "body", algorithm: str = "sais") -> DataFrame:
    """shard, sa_len, runs, alphabet_size of each row's index, without its rows leaving the task."""
    kernel = KERNELS[algorithm]

    def run(batches):
        for b in batches:
            out = []
            for value in b.column(1).to_pylist():
                data = value or b""
                bwt = np.append(np.frombuffer(data, np.uint8), 0).astype(np.int16)[kernel(data) - 1]
                out.append((len(bwt), int((bwt[1:] != bwt[:-1]).sum()) + 1, len(np.unique(bwt))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], pa.int64()) for k in range(3))], names=["shard", "sa_len", "runs", "alphabet_size"])

    rows = texts.select(F.col(shard).cast("long").alias("shard"), F.col(body).alias("body"))
    return rows.mapInArrow(run, "shard long, sa_len long, runs long, alphabet_size long")


def dealt(texts: DataFrame, shard: str = "doc_id") -> DataFrame:
    """Texts dealt to all cores by their keys: a small file may be one split or one row group, its suffixes are many times its bytes."""
    return texts.repartition(4 * texts.sparkSession.sparkContext.defaultParallelism, shard)


def _byte_counts(texts: DataFrame, shard: str, body: str, give, schema: str) -> DataFrame:
    """Counts of a shard's bytes and sentinel, which are those of its transform. Rows of a shard are neighbours
    in one task, so they are counted there, 4,096 shards and 1 MB at a time; nothing is grouped by a hash."""
    bound_batches(texts.sparkSession)

    def run(batches):
        key, n = None, None  # the last shard seen may have more rows
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                b = batch.slice(k, 4096)
                keys, value = b.column(0), b.column(1).fill_null(b"").cast(pa.large_binary())
                at = np.frombuffer(value.buffers()[1], np.int64)[value.offset : value.offset + len(value) + 1]
                number, valid = keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False)
                new = np.append(True, (number[1:] != number[:-1]) | (valid[1:] != valid[:-1]))
                run_of = np.cumsum(new) - 1
                counts = np.zeros(((run_of[-1] + 1), 256), np.int64)
                counts[:, 0] = np.bincount(run_of)  # sentinels
                for lo in range(int(at[0]), int(at[-1]), 1 << 20):
                    hi = min(lo + (1 << 20), int(at[-1]))
                    owner = run_of[np.searchsorted(at, np.arange(lo, hi), "right") - 1]
                    low = owner[0]
                    cells = np.bincount((owner - low) * 256 + np.frombuffer(value.buffers()[2], np.uint8, hi - lo, lo))
                    counts.ravel()[low * 256 : low * 256 + len(cells)] += cells
                own = keys.take(pa.array(np.flatnonzero(new)))
                if n is not None and key == own[0].as_py():
                    counts[0] += n[0]
                elif n is not None:
                    yield give(pa.array([key], pa.int64()), n)
                if len(counts) > 1:
                    yield give(own.slice(0, len(own) - 1), counts[:-1])
                key, n = own[len(own) - 1].as_py(), counts[-1:].copy()
        if n is not None:
            yield give(pa.array([key], pa.int64()), n)

    rows = dealt(texts.select(F.col(shard).cast("long").alias("shard"), F.col(body).alias("body")), "shard")
    return rows.sortWithinPartitions("shard").mapInArrow(run, schema)


def c_arrays(texts: DataFrame, shard: str = "doc_id", body: str = "body") -> DataFrame:
    """shard, byte, c of each shard's texts, as ``c_array`` of their suffix table gives them, without that table."""

    def give(keys, counts):
        row, byte = np.nonzero(counts)
        c = (np.cumsum(counts, axis=1) - counts)[row, byte]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(byte.astype(np.int32)), pa.array(c)], names=["shard", "byte", "c"])

    return _byte_counts(texts, shard, body, give, "shard long, byte int, c long")


def alphabet_sizes(texts: DataFrame, shard: str = "doc_id", body: str = "body") -> DataFrame:
    """shard, alphabet_size of each shard's texts, as ``alphabet_size`` of their suffix table gives them, without that table."""

    def give(keys, counts):
        return pa.RecordBatch.from_arrays([keys, pa.array(np.count_nonzero(counts, axis=1))], names=["shard", "alphabet_size"])

    return _byte_counts(texts, shard, body, give, "shard long, alphabet_size long")


def positions_in(texts: DataFrame, intervals: list[tuple[int, int]], shard: str = "doc_id", body: str = "body", algorithm: str = "sais") -> DataFrame:
    """shard, pos of the suffixes whose ranks are in the intervals, the same for each row's byte string, each once.
    They are taken where the string is sorted, so no other suffix leaves the task."""
    kernel = KERNELS[algorithm]
    asked = np.unique(np.concatenate([np.arange(lo, hi) for lo, hi in intervals] or [np.zeros(0, np.int64)]))
    bound_batches(texts.sparkSession)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                b = batch.slice(k, 4096)
                found = []
                for value in b.column(1).to_pylist():
                    sa = kernel(value or b"")
                    found.append(sa[asked[: np.searchsorted(asked, len(sa))]])
                row = np.repeat(np.arange(len(found)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(np.concatenate(found).astype(np.int64))], names=["shard", "pos"])

    rows = dealt(texts.select(F.col(shard).cast("long").alias("shard"), F.col(body).alias("body")), "shard")
    return rows.mapInArrow(run, "shard long, pos long")


def one_shard(corpus: Corpus) -> DataFrame:
    """The whole corpus as one row (shard 0); refused beyond ``MAX_SHARD`` bytes."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", (view(F.concat("body", "tail"))).alias("t")))), lambda x: x["t"]), "")
    size = corpus.stats().first()["text_len"]
    if size > MAX_SHARD:
        raise ValueError(f"a corpus of {size} bytes is too large for one shard; index by document")
    return corpus.rows.agg(F.coalesce(joined, F.lit("\0")).alias("t")).select(F.lit(0).cast("long").alias("shard"), F.encode(F.left("t", F.length("t") - 1), "ISO-8859-1").alias("body"))


def c_array(sa: DataFrame) -> DataFrame:
    """shard, byte, c: bytes below each byte of a shard's transform."""
    n = sa.groupBy("shard", F.col("bwt").cast("int").alias("byte")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("byte").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("shard", "byte", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("c"))


def alphabet_size(sa: DataFrame) -> DataFrame:
    return sa.groupBy("shard").agg(F.count_distinct("bwt").alias("alphabet_size"))


def runs(sa: DataFrame) -> DataFrame:
    """shard, run_id, byte, start, len, cum_before (same bytes in the runs before)."""
    w = Window.partitionBy("shard").orderBy("rank")
    marked = sa.withColumn("new", F.coalesce((F.col("bwt") != F.lag("bwt").over(w)).cast("long"), F.lit(0)))
    run = marked.withColumn("run_id", F.sum("new").over(w))
    out = run.groupBy("shard", "run_id").agg(F.first("bwt").cast("int").alias("byte"), F.min("rank").alias("start"), F.count("*").alias("len"))
    same = Window.partitionBy("shard", "byte").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("cum_before", F.coalesce(F.sum("len").over(same), F.lit(0)))


def run_count(sa: DataFrame) -> DataFrame:
    w = Window.partitionBy("shard").orderBy("rank")
    return sa.withColumn("new", F.coalesce((F.col("bwt") != F.lag("bwt").over(w)).cast("long"), F.lit(1))).groupBy("shard").agg(F.sum("new").alias("runs"))


def bwt_string(sa: DataFrame) -> DataFrame:
    """shard, bwt: the transform as hexadecimal digits."""
    each = F.array_sort(F.collect_list(F.struct("rank", "bwt")))
    return sa.groupBy("shard").agg(F.array_join(F.transform(each, lambda x: F.lpad(F.hex(x["bwt"]), 2, "0")), "").alias("bwt"))


def lf(sa: DataFrame) -> DataFrame:
    """shard, rank, label, to: the LF mapping, which stably sorts the transform."""
    w = Window.partitionBy("shard").orderBy("bwt", "rank")
    return sa.select("shard", "rank", F.col("bwt").cast("int").alias("label"), (F.row_number().over(w).cast("long") - 1).alias("to"))


def full_index(spark: SparkSession, corpus: Corpus, algorithm: str = "sais") -> DataFrame:
    """Suffix table of a small corpus as one shard."""
    return suffix_table(one_shard(corpus), "shard", "body", algorithm)


def sa_at(sa: DataFrame, rank: int) -> DataFrame:
    """shard, pos of the suffix of a rank."""
    return sa.where(F.col("rank") == rank).select("shard", "pos")


def lengths(sa: DataFrame) -> DataFrame:
    """shard, sa_len, text_len."""
    return sa.groupBy("shard").agg(F.count("*").alias("sa_len")).withColumn("text_len", F.col("sa_len") - 1)


def c_value(sa: DataFrame, byte: int) -> DataFrame:
    """shard, c: places of the transform with a smaller byte, whether or not the byte is there."""
    return sa.groupBy("shard").agg(F.count_if(F.col("bwt") < byte).alias("c"))


def occ_count(sa: DataFrame, byte: int, i: int) -> DataFrame:
    """shard, n: how often a byte is among the first i places of the transform."""
    return sa.groupBy("shard").agg(F.count_if((F.col("bwt") == byte) & (F.col("rank") < i)).alias("n"))


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """shard, lo, hi: half-open intervals joined where they overlap or touch; empty ones go."""
    w = Window.partitionBy("shard").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.where("lo < hi").withColumn("new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1)))
    return marked.withColumn("run", F.sum("new").over(w)).groupBy("shard", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def positions_of(sa: DataFrame, intervals: DataFrame) -> DataFrame:
    """shard, pos of all suffixes in the intervals, each once. Intervals are narrow and few; ranks of one
    shard are met by an equi-join on the shard's blocks of ranks, not by comparing all with all."""
    size = 4096
    spread = merge_intervals(intervals).withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    return sa.withColumn("block", F.floor(F.col("rank") / size)).join(spread, ["shard", "block"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("shard", "pos")
