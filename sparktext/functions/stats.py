"""Measurements: percentiles, summaries of benchmark records, amortisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "dataset string, dataset_bytes long, algo string, occ string, backend string, query_type string, query string, search_mode string, build_elapsed_sec double, build_peak_rss_kb long, index_bytes long, search_elapsed_ms double, search_p50_ms double, search_p95_ms double, search_peak_rss_kb long, hits long, run_id string"
METRICS = ("build_elapsed_sec", "index_bytes", "search_p50_ms", "search_p95_ms")


def percentile(col: str, p: float) -> Column:
    """Linear interpolation at (n - 1) * p of the sorted values."""
    return F.percentile(col, p)


def medians(records: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Median of each metric of warm rows by dataset, algorithm, backend and rank structure."""
    warm = records.where("search_mode = 'warm'")
    return warm.groupBy("dataset", "algo", "backend", "occ").agg(*(F.median(m).alias(m) for m in metrics))


def best(records: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """dataset, metric, algo, backend, occ, value: the configuration with the least median of each metric."""
    m = medians(records, metrics)
    long = m.select("dataset", "algo", "backend", "occ", F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).cast("double").alias("value")) for x in metrics))).alias("x")).select("dataset", "algo", "backend", "occ", "x.*")
    pick = F.min(F.struct("value", "algo", "backend", "occ")).alias("b")
    return long.where("value is not null").groupBy("dataset", "metric").agg(pick).select("dataset", "metric", "b.algo", "b.backend", "b.occ", "b.value")


def amortisation(build_sec: Column, scan_ms: Column, index_ms: Column) -> Column:
    """Queries after which building an index pays."""
    return build_sec * 1000 / (scan_ms - index_ms)


def write_records(records: DataFrame, path: str) -> None:
    """Benchmark records as CSV with a header, columns in the order of RECORD."""
    records.select(*(c.split()[0] for c in RECORD.split(", "))).write.mode("overwrite").csv(path, header=True)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=RECORD, header=True)
