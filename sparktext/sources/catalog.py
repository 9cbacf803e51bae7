"""Saved indexes: one folder with the corpus, the shards that searches read, the suffix tables, a rank table and a manifest.

Everything is written and read by Spark, so a folder may be in any store. Loading looks at the manifest
to tell the backend, and refuses manifests whose fields don't fit together or the tables.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.options import BACKENDS, OCC_ID, PERSIST_ID, Storage, magic, normalize
from ..operators import fm as fm_ops
from ..operators import occ as occ_ops
from ..operators import search as ops
from ..operators import suffix
from .corpus import Corpus

MAX_LENGTH = (1 << 63) // 4


@dataclass
class Index:
    """A corpus with the options and tables of its index."""

    corpus: Corpus
    backend: str = "fm"
    algorithm: str = "sais"
    occ: str = "rlbwt"
    storage: Storage = Storage()
    sa: DataFrame | None = None
    rev: DataFrame | None = None
    fm: DataFrame | None = None

    @property
    def magic(self) -> str:
        return magic(self.backend, self.occ, self.storage)

    def search(self, pattern: str, limit: int = 0, compat: bool = False) -> ops.Result:
        """A star-free expression for the fm backend, a literal for the others."""
        if self.backend == "fm":
            return ops.search(self.corpus, pattern, limit, self.fm)
        return ops.search_literal(self.corpus, pattern, limit, self.backend, compat, self.fm)

    def append(self, df: DataFrame, text: str = "text", key: str = "doc_id") -> Index:
        """The index of the corpus with more text at its end; options stay. Nothing to add: unchanged."""
        if df.isEmpty():
            return self
        return build(self.corpus.append(df, text, key), self.backend, self.algorithm, self.occ, self.storage)

    def info(self) -> DataFrame:
        """One row: backend, text_len, sa_len, alphabet_size, occ, storage, bwt_runs (fm only)."""
        s = self.corpus.stats().first()
        fm = self.backend == "fm"
        # of one suffix table, or of the shards' (each shard has its own transform)
        r = (suffix.run_count(self.sa) if self.sa is not None else self.fm.agg(F.sum("runs").alias("runs"))).first()["runs"] if fm else None
        a = self.corpus.alphabet_size().first()["alphabet_size"] if fm else None
        spark = self.corpus.rows.sparkSession
        return spark.createDataFrame([(self.backend, s["text_len"], s["sa_len"] if fm else None, a, self.occ if fm else None, str(self.storage) if fm else None, r)], "backend string, text_len long, sa_len long, alphabet_size long, occ string, storage string, bwt_runs long")


def build(corpus: Corpus, backend: str = "fm", algorithm: str = "sais", occ: str = "rlbwt", storage: Storage = Storage()) -> Index:
    """An index of a corpus of any size: shards with rank columns, which searches use. Up to
    ``suffix.MAX_SHARD`` bytes there is one suffix table of the whole corpus too, for graphs and traces."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}")
    occ, storage = normalize(occ, storage)
    size = corpus.stats().first()["text_len"]
    shards = fm_ops.build(corpus, algorithm=algorithm).persist()
    if size > suffix.MAX_SHARD:
        return Index(corpus, backend, algorithm, occ, storage, fm=shards)
    one = suffix.one_shard(corpus)
    sa = suffix.suffix_table(one, "shard", "body", algorithm)
    rev = None
    if backend == "bifm":
        mirror = one.select("shard", F.encode(F.reverse(F.decode("body", "ISO-8859-1")), "ISO-8859-1").alias("body"))
        rev = suffix.suffix_table(mirror, "shard", "body", algorithm)
    return Index(corpus, backend, algorithm, occ, storage, sa, rev, shards)


def save(index: Index, path: str) -> DataFrame:
    """Write an index; one row per table with the rows written. Externally stored rank tables are laid
    out by their strategy: appended (lsm), ordered by place (bplustree) or in 8 shards (inverted)."""
    spark = index.corpus.rows.sparkSession
    written = []

    def put(name: str, df: DataFrame, by: str | None = None, order: list[str] | None = None, **options: str) -> None:
        if order:
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        w = df.write.mode("overwrite").options(**options)
        (w.partitionBy(by) if by else w).parquet(f"{path}/{name}")
        written.append((name, spark.read.parquet(f"{path}/{name}").count()))

    put("corpus", index.corpus.df)
    if index.fm is not None:
        put("fm", index.fm, **fm_ops.WRITE)
    if index.sa is not None:
        put("sa", index.sa, order=["shard", "rank"])
        if index.backend == "fm" and (index.occ == "bitvectors" or index.storage.mode == "external"):
            sa = spark.read.parquet(f"{path}/sa")
            table = occ_ops.ENCODE[index.occ](sa)
            place = "word" if "word" in table.columns else "k"
            if index.storage.mode == "external" and index.storage.strategy == "inverted":
                put("occ", table.withColumn("part", F.pmod(F.col(place), F.lit(8)).cast("int")), by="part")
            elif index.storage.strategy == "bplustree" and index.storage.mode == "external":
                put("occ", table, order=[place])
            else:
                put("occ", table)
        if index.rev is not None:
            put("rev", index.rev, order=["shard", "rank"])
    s = index.corpus.stats().first()
    manifest = {"backend": index.backend, "algorithm": index.algorithm, "occ": index.occ, "mode": index.storage.mode, "strategy": index.storage.strategy, "block_size": index.storage.block_size, "sep": index.corpus.sep.hex(), "docs": s["docs"], "text_len": s["text_len"], "sa_len": s["sa_len"], "magic": index.magic, "tables": dict(written)}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")
    return spark.createDataFrame(written, "table string, rows long")


def _manifest(spark: SparkSession, path: str) -> dict:
    # a name that starts with _ is hidden to folder scans but not as a path of its own
    rows = spark.read.text(f"{path}/_manifest").collect()
    if len(rows) != 1:
        raise ValueError("not an index: no manifest")
    try:
        m = json.loads(rows[0][0])
    except ValueError:
        raise ValueError("not an index: the manifest can't be read") from None
    return m


def validate(m: dict) -> None:
    """Refuse a manifest whose fields are missing, out of range or don't fit together."""
    missing = {"backend", "algorithm", "occ", "mode", "strategy", "block_size", "sep", "text_len", "sa_len", "magic"} - m.keys()
    if missing:
        raise ValueError(f"manifest lacks {', '.join(sorted(missing))}")
    n, t = m["sa_len"], m["text_len"]
    if not isinstance(n, int) or not 1 <= n <= MAX_LENGTH or t != n - 1:
        raise ValueError(f"bad lengths in manifest: text {t}, suffixes {n}")
    if m["backend"] not in BACKENDS or m["algorithm"] not in suffix.KERNELS or m["occ"] not in OCC_ID or m["strategy"] not in PERSIST_ID or m["mode"] not in ("memory", "external"):
        raise ValueError("unknown option in manifest")
    storage = Storage(m["mode"], m["strategy"], m["block_size"])
    if normalize(m["occ"], storage) != (m["occ"], storage):
        raise ValueError("storage in manifest doesn't fit the rank structure")
    if m["magic"] != magic(m["backend"], m["occ"], storage):
        raise ValueError(f"manifest of type {m['magic']} has options of another type")


def load(spark: SparkSession, path: str) -> Index:
    """A saved index of any backend."""
    m = _manifest(spark, path)
    validate(m)
    corpus = Corpus(spark.read.parquet(f"{path}/corpus"), bytes.fromhex(m["sep"]))
    if corpus.stats().first()["sa_len"] != m["sa_len"]:
        raise ValueError("corpus and manifest differ in length")
    tables = m.get("tables", {})
    sa = spark.read.parquet(f"{path}/sa") if "sa" in tables else None
    if sa is not None and sa.count() != m["sa_len"]:
        raise ValueError("suffix table and manifest differ in length")
    rev = spark.read.parquet(f"{path}/rev") if "rev" in tables else None
    return Index(corpus, m["backend"], m["algorithm"], m["occ"], Storage(m["mode"], m["strategy"], m["block_size"]), sa, rev, spark.read.parquet(f"{path}/fm") if "fm" in tables else None)
