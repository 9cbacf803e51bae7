"""One query for each operator of this subpackage, over its whole table, and the SQL that gives
the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, hmm, langid, licenses, phrases, quality, rules, simhash, suffixdedup
from ._common import read

#: The rank file of op6; the folder of public tokenizers is a parameter of the machine.
RANKS = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op1_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(read(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("longest_match")


def op5_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(read(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary())


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, quality.graded(read(spark, sf_dir, "labels")))
    return quality.score(docs, model).withColumnRenamed("selected", "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return licenses.scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))), "path")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ITEM_WORDS}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ITEM_WORDS}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item_id, w, least(8, len(w)) AS n, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw))),
hits AS (SELECT doc_id, n, p, item_id FROM dw JOIN iw USING (n, g)),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""

_OP5 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
lost AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM lost),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM d) ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_OP8 = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, p, b[p:p + 99] AS g FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS p FROM d WHERE n >= 100)),
lost AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
runs AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run, p FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM lost)),
cut AS (SELECT doc_id, run, min(p) AS s, max(p) + 100 AS e FROM runs GROUP BY doc_id, run),
stays AS (SELECT doc_id, coalesce(lag(e) OVER w, 1) AS a, s - 1 AS z FROM cut WINDOW w AS (PARTITION BY doc_id ORDER BY s) UNION ALL SELECT doc_id, max(e), 1000000000 FROM cut GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[a:z]), '' ORDER BY a) AS h FROM stays JOIN d USING (doc_id) WHERE z >= a AND a <= n GROUP BY doc_id),
sums AS (SELECT doc_id, sum(e - s) AS gone, count(*) AS spans FROM cut GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(CASE WHEN spans IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: their models or fingerprints can't be told in it; tests compare them
    with brute force."""
    return {"op4_decontamination": _OP4, "op5_phrase_dedup": _OP5, "op8_suffix_dedup": _OP8}
