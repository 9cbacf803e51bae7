"""The Wheeler graph of an index: nodes are suffixes in order, edges the LF mapping labelled with the
byte before. As DataFrames, and as Mermaid text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.byteview import suffix_preview, view
from .suffix import lf


def nodes(texts: DataFrame, sa: DataFrame, shard: str = "doc_id", body: str = "body", size: int = 12) -> DataFrame:
    """shard, rank, pos, preview (``size`` bytes and $)."""
    t = texts.select(F.col(shard).cast("long").alias("shard"), view(body).alias("t"))
    return sa.join(t, "shard").select("shard", "rank", "pos", suffix_preview(F.col("t"), F.col("pos"), size).alias("preview"))


def edges(sa: DataFrame) -> DataFrame:
    """shard, src, dst, label."""
    b = F.col("label")
    label = F.when(b == 0, "$").when((b >= 32) & (b <= 126) & (b != 34), F.chr(b.cast("long"))).otherwise(F.concat(F.lit("0x"), F.lpad(F.hex(b.cast("long")), 2, "0")))
    return lf(sa).select("shard", F.col("rank").alias("src"), F.col("to").alias("dst"), label.alias("label"))


def mermaid(texts: DataFrame, sa: DataFrame, max_nodes: int = 0, shard: str = "doc_id", body: str = "body") -> DataFrame:
    """shard, mermaid: a flowchart of the first ``max_nodes`` nodes (all for 0 or less)."""
    n = sa.groupBy("shard").agg(F.count("*").alias("n")).withColumn("m", F.when(F.lit(max_nodes) <= 0, F.col("n")).otherwise(F.least(F.col("n"), F.lit(max_nodes))))
    quoted = F.replace(F.col("preview"), F.lit('"'), F.lit('\\\\"'))
    shown = nodes(texts, sa, shard, body).join(F.broadcast(n), "shard").where("rank < m")
    lines = shown.select("shard", F.lit(0).alias("part"), "rank", F.format_string('  n%d["%d: SA=%d %s"]\n', "rank", "rank", "pos", quoted).alias("line"))
    out = edges(sa).join(F.broadcast(n), "shard").where("src < m")
    kept = out.where("dst < m").select("shard", F.lit(1).alias("part"), F.col("src").alias("rank"), F.format_string('  n%d --"%s"--> n%d\n', "src", "label", "dst").alias("line"))
    hidden = out.groupBy("shard").agg(F.count_if(F.col("dst") >= F.col("m")).alias("hidden"))
    body_ = lines.unionAll(kept).groupBy("shard").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "rank", "line"))), lambda x: x["line"]), "").alias("text"))
    head = F.lit("flowchart LR\n  %% Node order is the Wheeler order (SA rank).\n")
    more = F.when(F.col("m") < F.col("n"), F.concat(F.format_string('  hidden[("... %d more nodes omitted")]\n', F.col("n") - F.col("m")), F.when(F.col("hidden") > 0, F.concat(F.format_string('  note["%d edges to omitted nodes"]\n', "hidden"), F.lit("  note -.-> hidden\n"))).otherwise(""))).otherwise("")
    return body_.join(hidden, "shard").join(n, "shard").select("shard", F.concat(head, "text", more).alias("mermaid"))
