"""FM-indexes in shards: literals and star-free expressions by backward search on rank structures.

A shard holds whole neighbouring documents (about ``SHARD`` bytes, or one longer document) and is one row:
its counts of smaller bytes (C), one rank column for each byte (the ranks at which the transform has it, so
that the number before a rank is a binary search) and its suffix array. A query reads the columns of the
bytes that its pattern may match and nothing of the text; counting reads no suffix array. Every shard is
searched in its own task's memory, nothing is shuffled, and shards are bounded, so the index grows by rows.

A set of suffixes is a list of intervals of ranks. A byte takes each interval one step back; alternatives
are unions, whose intervals are joined where they meet, so a suffix counts once however many ways match.

Patterns that match nothing, or a separator (and so over the end of a document), are not for the index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bound_batches
from ..plans.regex import Program
from ..sources.corpus import Corpus
from . import suffix

#: Bytes of the documents that start in one shard.
SHARD = 1 << 20

#: Options of a written index. A row is about nine times its text: row groups are looked at after each row (by
#: default after 100), and neither dictionaries nor least and greatest values, whole columns here, are kept in memory.
WRITE = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false"}


def build(corpus: Corpus, size: int = SHARD, algorithm: str = "sais") -> DataFrame:
    """shard, start, n (suffixes), runs, c, sa, b0..b255 (null: no such byte), and its documents' ids, orders, starts."""
    kernel = suffix.KERNELS[algorithm]
    spark = corpus.rows.sparkSession
    bound_batches(spark)
    docs = corpus.df.select(F.floor(F.col("start") / size).alias("shard"), "start", "ord", "doc_id", F.concat("body", "tail").alias("t"), "byte_len")
    # neighbouring shards go to different tasks, and few to one: sorting suffixes takes long for so few bytes
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "ord")
    kind = dict(docs.dtypes)["doc_id"]

    def row(held: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        # the corpus' own sentinel is the shard's
        data = b"".join(d["t"] for d in held)
        data = data[:-1] if data.endswith(b"\0") else data
        sa = kernel(data)
        bwt = np.append(np.frombuffer(data, np.uint8), np.uint8(0)).astype(np.int16)[sa - 1]
        order = np.argsort(bwt, kind="stable")
        c = np.searchsorted(bwt[order], np.arange(257))
        base = held[0]["start"]
        delta = [np.diff(order[c[k] : c[k + 1]], prepend=0).astype("<i4").tobytes() if k and c[k] < c[k + 1] else None for k in range(256)]
        cols = [("shard", [held[0]["shard"]], pa.int64()), ("start", [base], pa.int64()), ("n", [len(sa)], pa.int64()), ("runs", [int((bwt[1:] != bwt[:-1]).sum()) + 1], pa.int64()), ("c", [c.tolist()], pa.list_(pa.int64())), ("sa", [sa.astype("<i4").tobytes()], pa.binary()),
                ("ids", [[d["doc_id"] for d in held]], pa.list_(kind)), ("ords", [[d["ord"] for d in held]], pa.list_(pa.int64())), ("starts", [[d["start"] - base for d in held]], pa.list_(pa.int64()))]
        cols += [(f"b{k}", [v], pa.binary()) for k, v in enumerate(delta)]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for _, v, t in cols], names=[n for n, _, _ in cols])

    def run(batches):
        held: list[dict] = []
        for b in batches:
            for d in b.to_pylist():
                if held and d["shard"] != held[0]["shard"]:
                    yield row(held, b.schema.field("doc_id").type)
                    held = []
                held.append(d)
            last = b.schema.field("doc_id").type
        if held:
            yield row(held, last)

    return dealt.mapInArrow(run, f"shard long, start long, n long, runs long, c array<long>, sa binary, ids array<{kind}>, ords array<long>, starts array<long>, " + ", ".join(f"b{k} binary" for k in range(256)))


def _join(intervals: np.ndarray) -> np.ndarray:
    """Intervals (rows lo, hi) without empty ones, joined where they meet."""
    x = intervals[intervals[:, 0] < intervals[:, 1]]
    x = x[np.argsort(x[:, 0], kind="stable")]
    if len(x) < 2:
        return x
    reach = np.maximum.accumulate(x[:, 1])
    first = np.flatnonzero(np.concatenate([[True], x[1:, 0] > reach[:-1]]))
    return np.stack([x[first, 0], np.append(reach[first[1:] - 1], reach[-1])], 1)


def evaluate(program: Program, c, ranks: dict[int, np.ndarray], intervals: np.ndarray) -> np.ndarray:
    """Intervals of the suffixes that start with a match of the program followed by a suffix of ``intervals``."""
    kind, arg = program[0], program[1]
    if not len(intervals):
        return intervals
    if kind == "bytes":
        found = [c[b] + np.searchsorted(ranks[b], intervals) for b in arg if b in ranks]
        return _join(np.concatenate(found)) if found else intervals[:0]
    if kind == "all":
        for p in reversed(arg):
            intervals = evaluate(p, c, ranks, intervals)
        return intervals
    if kind == "any":
        return _join(np.concatenate([evaluate(p, c, ranks, intervals) for p in arg]))
    low, high = program[2:]
    done = []
    for k in range(high + 1):
        if k >= low:
            done.append(intervals)
        if k < high:
            intervals = evaluate(arg, c, ranks, intervals)
    return _join(np.concatenate(done))


def _searched(index: DataFrame, program: Program, accepts: frozenset[int], more: list[str], give, schema: str) -> DataFrame:
    used = sorted(accepts)
    bound_batches(index.sparkSession)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                n, c = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                cells = {x: b.column(2 + j)[k] for j, x in enumerate(used)}
                ranks = {x: np.cumsum(np.frombuffer(v.as_buffer(), "<i4"), dtype=np.int64) for x, v in cells.items() if v.is_valid}
                found = evaluate(program, c, ranks, np.array([[0, n]], np.int64))
                if len(found):
                    yield give(found, [b.column(2 + len(used) + j)[k] for j in range(len(more))])

    return index.select("n", "c", *(f"b{x}" for x in used), *more).mapInArrow(run, schema)


def count(index: DataFrame, program: Program, accepts: frozenset[int]) -> DataFrame:
    """n: places at which the pattern matches."""

    def give(found, _):
        return pa.RecordBatch.from_arrays([pa.array([int((found[:, 1] - found[:, 0]).sum())])], names=["n"])

    return _searched(index, program, accepts, [], give, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def positions(index: DataFrame, program: Program, accepts: frozenset[int]) -> DataFrame:
    """doc_id, ord, local, pos: each match start."""
    kind = dict(index.dtypes)["ids"].removeprefix("array<")[:-1]

    def give(found, row):
        sa = np.frombuffer(row[0].as_buffer(), "<i4")
        at = np.sort(np.concatenate([sa[lo:hi] for lo, hi in found.tolist()]).astype(np.int64))
        starts = row[3].values.to_numpy()
        doc = np.searchsorted(starts, at, "right") - 1
        return pa.RecordBatch.from_arrays([row[1].values.take(pa.array(doc)), row[2].values.take(pa.array(doc)), pa.array(at - starts[doc]), pa.array(at + row[4].as_py())], names=["doc_id", "ord", "local", "pos"])

    return _searched(index, program, accepts, ["sa", "ids", "ords", "starts", "start"], give, f"doc_id {kind}, ord long, local long, pos long")
