"""Helpers that the operators of this subpackage share: reading tables, shared scratch
tables, bounded chunks of Arrow batches and hashing of tokens."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import bound_batches

#: Bytes of text that a Python worker gathers before it works on them together.
CHUNK_BYTES = 4 << 20

_scratch: "weakref.WeakKeyDictionary[object, list[str]]" = weakref.WeakKeyDictionary()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a data folder."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``).

    Only where the setting is missing and all runs on one machine, as in tests, is a temporary folder made;
    on a cluster that would be another folder on each machine, so it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        where = tempfile.mkdtemp(prefix="sparktext-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        try:
            _delete(spark, p)
        except Exception:  # the session has ended; its folder goes with the cluster's cleaning
            return


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives
    lost executors. The files go when the session's Python process ends."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/sparktext-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(compression="zstd", **options).parquet(path)
    paths = _scratch.get(spark.sparkContext)
    if paths is None:
        paths = _scratch[spark.sparkContext] = []
        atexit.register(_forget, spark, paths)
    paths.append(path)
    release(spark)
    return spark.read.schema(schema).parquet(path)


def drop_tables(spark: SparkSession, keep: int, last: int = 1) -> None:
    """Delete the written tables but for the first ``keep`` and the ``last`` ones: what a finished stage has used."""
    paths = _scratch.get(spark.sparkContext, [])
    for p in paths[keep:-last]:
        _delete(spark, p)
    del paths[keep:-last]


def tables(spark: SparkSession) -> int:
    """How many written tables there are."""
    return len(_scratch.get(spark.sparkContext, []))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no live plan refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(col: str = "text"):
    """The UTF-8 bytes of a text column; null stays null."""
    return F.encode(F.col(col), "UTF-8")


def chunks(batches: Iterator[pa.RecordBatch], size_of: int, limit: int = CHUNK_BYTES) -> Iterator[list[list]]:
    """Columns as lists, cut so that column ``size_of`` (bytes or None) holds about ``limit`` bytes.

    One very long value makes a chunk of its own; nothing is cut inside a value.
    """
    held: list[list] | None = None
    size = 0
    for b in batches:
        for row0 in range(0, b.num_rows, 1024):
            part = b.slice(row0, 1024)
            cols = [c.to_pylist() for c in part.columns]
            held = held or [[] for _ in cols]
            start = 0
            for k, v in enumerate(cols[size_of]):
                size += len(v) if v is not None else 0
                if size >= limit:
                    for h, c in zip(held, cols):
                        h += c[start : k + 1]
                    yield held
                    held, size, start = [[] for _ in cols], 0, k + 1
            for h, c in zip(held, cols):
                h += c[start:]
    if held and held[0]:
        yield held


#: What a worker drops at the end of each task: caches that another operator's tasks would carry along.
_at_end: list[Callable[[], None]] = []


def at_task_end(drop: Callable[[], None]) -> None:
    _at_end.append(drop)


def relax() -> None:
    """Drop caches and give memory that is free again back to the system: workers live on between
    tasks, and what one operator needed at its peak would be missing for the next."""
    for drop in _at_end:
        drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with bounded batches that leaves no free memory behind in its workers."""
    bound_batches(df.sparkSession)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            relax()

    return df.mapInArrow(run, schema)


def map_chunks(df: DataFrame, fn: Callable[[list[list]], pa.RecordBatch | None], schema: str, size_of: int = 1, limit: int = CHUNK_BYTES) -> DataFrame:
    """Run ``fn`` on bounded chunks of ``df`` in Arrow batches."""

    def run(batches):
        for c in chunks(batches, size_of, limit):
            out = fn(c)
            if out is not None and out.num_rows:
                yield out

    return map_arrow(df, run, schema)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def crc_mod(doc_id, n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(n))
