"""Preparation of texts: FASTA, CSV and TSV, Japanese encodings, synthetic corpora."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of column names that mark text columns.
TEXT_COLUMNS = ("title", "name", "product", "brand", "description", "about", "category", "model", "feature", "spec", "review", "text")


def fasta(spark: SparkSession, path: str, select: str | None = None) -> DataFrame:
    """record, header, sequence of FASTA files: lines joined, upper case. ``select``: a regular expression
    that headers must match (an error if none does). Files are read whole, records cut at headers."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    parts = files.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "(?m)^>")).alias("record", "t")).where("trim(t) <> ''")
    head = F.trim(F.substring_index("t", "\n", 1))
    body = F.expr("substring(t, length(substring_index(t, '\n', 1)) + 1)")
    out = parts.where("record > 0").select("file", "record", head.alias("header"), F.upper(F.regexp_replace(body, r"\s+", "")).alias("sequence"))
    if select is not None:
        out = out.where(F.rlike("header", F.lit(select)))
        if out.isEmpty():
            raise ValueError(f"no FASTA record matches {select!r}")
    return out


def table_texts(df: DataFrame) -> DataFrame:
    """text: the rows' text columns (by name; all if none is), white space collapsed, joined by `` | ``;
    rows without any text are left out."""
    chosen = [c for c in df.columns if any(t in c.lower() for t in TEXT_COLUMNS)] or df.columns
    clean = [F.nullif(F.trim(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\s+", " ")), F.lit("")) for c in chosen]
    return df.select(F.concat_ws(" | ", *clean).alias("text")).where("text <> ''")


def csv_texts(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Texts of CSV (or, by their name, TSV) files with a header."""
    sep = "\t" if path.lower().endswith(".tsv") else ","
    return table_texts(spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, quote='"', escape='"'))


def decoded(spark: SparkSession, path: str, encoding: str = "cp932") -> DataFrame:
    """path, text of files in another encoding (Windows' Japanese one unless told). Spark's own decoder
    knows Unicode and Latin-1 only, so batches of files are decoded in Python."""

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode(encoding, "replace"))

    return spark.read.format("binaryFile").load(path).select("path", decode("content").alias("text"))


def synthetic(spark: SparkSession, block: str, size: int) -> DataFrame:
    """body: a block and a line break, repeated and cut to exactly ``size`` bytes."""
    unit = block.encode() + b"\n"
    times = -(-size // len(unit))
    view = F.substring(F.repeat(F.lit(unit.decode("latin-1")), F.lit(times)), 1, size)
    return spark.range(1).select(F.encode(view, "ISO-8859-1").alias("body"))


def lines(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, line_no, line for each line of each text."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with doc_id 0.. in an order; for names and other short rows, as one task numbers them."""
    return df.withColumn("doc_id", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
