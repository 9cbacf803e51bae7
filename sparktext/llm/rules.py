"""Operator 9: quality rules with risk-controlled thresholds.

Each rule rejects a document whose statistic is at or beyond a cutoff. Cutoffs are selected on
labelled holdout documents (label 1: good): per stratum the strictest ones for which the share of good
documents that any of the rules rejects is below ``risk`` with exact binomial (Clopper-Pearson)
confidence. A quarter of the holdout, dealt by a hash of doc_id, orders the steps: one after the other, the
rule goes to its next grid point whose step rejects the fewest more. On the other three quarters the
resulting sets of cutoffs are tested in that order, from lenient to strict (fixed sequence), and testing
stops at the first failure, which needs no correction. The error probability ``delta`` is split over the
strata (Bonferroni), so with probability 1 - delta no stratum is beyond its risk.

Documents are measured in one pass; holdout documents are counted by Spark per stratum, part and grid
points of the three rules, a table whose size is bounded but for the strata. A stratum with too few
labelled documents gets no cutoff, so its documents pass.

Edge cases: null texts have no words (all counts 0) and fail the base test; null strata form a
stratum of their own; repeated label rows of one document count by the lower label; labels without a
document are ignored; extra columns are ignored. Good documents that fail the base test are outside the
guarantee: the base test rejects whatever labels say.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_chunks, table

#: Rules: name, SQL of the statistic over the measured columns. Higher is worse.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
}
#: Cutoffs that are tried, from lenient to strict.
GRID = tuple(round(0.9 - 0.05 * k, 2) for k in range(17)) + (0.08, 0.06, 0.05, 0.04, 0.03, 0.02)
#: Strata beyond this number are refused, as the cutoffs are kept on the driver.
MAX_STRATA = 10_000

_NO_SYMBOL = bytes(c for c in range(256) if c not in b"#*$%&|<>")
_CONTINUED = bytes(range(0x80, 0xC0))


def measure(data: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word)."""
    if not data:
        return 0, 0, 0, 0, 0, 0
    words = data.split()
    n = len(words)
    chars = len(b"".join(words).translate(None, _CONTINUED))
    symbols = len(data.translate(None, _NO_SYMBOL))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
        size = len(ids)
        # three words as one integer if that fits, else by ranks of pairs
        if size < 2_000_000:
            tri = (w[:-2] * size + w[1:-1]) * size + w[2:]
        else:
            pair = np.unique(w[:-1] * size + w[1:], return_inverse=True)[1]
            tri = pair[:-1] * size + w[2:]
        order = np.argsort(tri, kind="stable")
        t = tri[order]
        same = t[1:] == t[:-1]
        if same.any():
            at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
            mark = np.zeros(n, bool)
            mark[at] = mark[at + 1] = mark[at + 2] = True
            repeat = int(mark.sum())
    return n, chars, symbols, dup, repeat, len(lines)


def measures(docs: DataFrame, stratum: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(cols):
        found = np.array([measure(t) for t in cols[1]], np.int64).reshape(-1, 6)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[2], pa.string()), *(pa.array(found[:, k]) for k in range(6))], names=["doc_id", "stratum", *names])

    rows = docs.select(F.col(key).cast("long"), F.encode(text, "UTF-8"), F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")))
    return map_chunks(rows, run, "doc_id long, stratum string, " + ", ".join(f"{x} long" for x in names))


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    f = d
    m = 1
    while m < 100_000:
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-13:
            break
        m += 1
    return front * f


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact binomial (Clopper-Pearson) upper confidence bound of a share after k cases among n:
    the p at which P(X <= k) = 1 - I_p(k + 1, n - k) = delta."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if 1 - beta_share(mid, k + 1, n - k) > delta:
            low = mid
        else:
            high = mid
    return high


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, key: str = "doc_id", label: str = "quality") -> dict[tuple[str, str], float]:
    """(stratum, rule) to cutoff, from all labelled documents that are good and pass the base test."""
    good = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.min(label).alias("label")).where("label = 1").select("doc_id")
    held = measured.where(~_base()).join(good, "doc_id", "left_semi")
    # good documents by stratum, part and the number of grid points that each rule passes them at
    points = [f"p_{name}" for name in RULES]
    at = [sum((F.when(F.expr(sql) < c, 1).otherwise(0) for c in GRID), F.lit(0)).alias(p) for p, sql in zip(points, RULES.values())]
    part = (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("tune")
    met = held.select("stratum", part, *at)
    if len(met.select("stratum").distinct().limit(MAX_STRATA + 1).collect()) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    strata: dict[str, list] = {}
    for r in met.groupBy("stratum", "tune", *points).agg(F.count("*").alias("n")).collect():
        strata.setdefault(r["stratum"], []).append((r["tune"], r["n"], *(r[p] for p in points)))
    out = {}
    for stratum, rows in strata.items():
        rows = np.array(rows, np.int64)
        for name, k in zip(RULES, _steps(rows[rows[:, 0] == 1, 1:], rows[rows[:, 0] == 0, 1:], risk, delta / len(strata))):
            if k:
                out[stratum, name] = GRID[k - 1]
    return out


def _steps(tune: np.ndarray, test: np.ndarray, risk: float, level: float) -> list[int]:
    """Grid points (their number, 0: no cutoff) that each rule may go to. Rows: documents, and by
    rule the number of grid points at which they pass."""
    now, n = [0] * len(RULES), int(test[:, 0].sum())

    def rejected(rows: np.ndarray, cuts: list[int]) -> int:
        return int(rows[(rows[:, 1:] < np.array(cuts)).any(1), 0].sum())

    while True:
        nexts = [[*now[:k], now[k] + 1, *now[k + 1 :]] for k in range(len(now)) if now[k] < len(GRID)]
        if not nexts:
            return now
        # fewest rejections first, then the rule that has gone least far
        step = min(nexts, key=lambda x: (rejected(tune, x), max(a for a, b in zip(x, now) if a != b)))
        if upper_bound(rejected(test, step), n, level) > risk:
            return now
        now = step


def _base():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Per document: its measures, base_failed, kept, the rules that rejected it, and the number of cutoffs that
    its stratum has (0: too few labels to bound the risk, so nothing but the base test rejects)."""
    spark = docs.sparkSession
    measured = table(measures(docs, stratum, text, key), "op9")
    cuts = calibrate(measured, labels, risk, delta, key, label)
    rules = spark.createDataFrame([(s, n, c) for (s, n), c in cuts.items()], "stratum string, rule string, cutoff double")
    wide = rules.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == n, F.col("cutoff"))).alias(f"cut_{n}") for n in RULES), F.count("*").alias("cutoffs"))
    joined = measured.join(F.broadcast(wide), "stratum", "left")  # at most MAX_STRATA rows
    broken = F.filter(F.array(*(F.when(F.expr(sql) >= F.col(f"cut_{n}"), F.lit(n)) for n, sql in RULES.items())), lambda x: x.isNotNull())
    return joined.withColumn("base_failed", _base()).withColumn("broken", broken).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken", F.coalesce("cutoffs", F.lit(0)).alias("cutoffs"))
