"""Bit vectors that change: a table (place, bit), rank and select-free edits as rewrites of the table.

An edit is a narrow map over the rows: places behind an inserted or removed bit move by one. Edits can be
chained; nothing is computed until rows are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vector(spark: SparkSession, bits: list[int]) -> DataFrame:
    """place, bit."""
    return spark.createDataFrame([(k, int(b)) for k, b in enumerate(bits)], "place long, bit int")


def set_bit(v: DataFrame, place: int, bit: int = 1) -> DataFrame:
    """The vector with one bit set (or, for 0, cleared)."""
    return v.select("place", F.when(F.col("place") == place, F.lit(bit)).otherwise(F.col("bit")).alias("bit"))


def insert_bit(v: DataFrame, place: int, bit: int) -> DataFrame:
    """The vector with a bit put in before a place; those from there on move up."""
    moved = v.select((F.col("place") + (F.col("place") >= place).cast("long")).alias("place"), "bit")
    return moved.unionAll(v.sparkSession.range(1).select(F.lit(place).cast("long").alias("place"), F.lit(bit).cast("int").alias("bit")))


def delete_bit(v: DataFrame, place: int) -> DataFrame:
    """The vector without the bit at a place; those behind it move down."""
    return v.where(F.col("place") != place).select((F.col("place") - (F.col("place") > place).cast("long")).alias("place"), "bit")


def ranks(v: DataFrame, places: list[int]) -> DataFrame:
    """i, rank1, rank0: ones and zeros before each place; places beyond the ends are taken to the ends."""
    one = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.coalesce(F.sum(F.when(F.col("place") < i, F.col("bit"))), F.lit(0)).cast("long").alias("rank1"), F.count(F.when(F.col("place") < i, 1)).alias("n")) for i in places))
    return v.agg(one.alias("x")).select(F.explode("x").alias("x")).select("x.i", "x.rank1", (F.col("x.n") - F.col("x.rank1")).alias("rank0"))
