"""Arrow batches of bounded bytes: texts may be long, so a batch of many rows may be large."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of a batch that goes to a Python worker at once (rows are never cut).
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows: texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
