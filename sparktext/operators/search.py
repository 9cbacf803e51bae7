"""Search by scanning: overlapping literal and star-free regular-expression matches as Catalyst
expressions on the byte view. Nothing is indexed and no text is shuffled, but for patterns that can
match over the end of a document: those read the next bytes of the corpus (the halo) as well.

Matching is that of an index of all suffixes: matches overlap, a position counts once, the sentinel
after the text is a byte that negated classes accept, and the text goes round to its start after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.byteview import context, view
from ..plans.regex import Matcher, Program, check, compile_literal, compile_tree, literal_program, program
from ..sources.corpus import GROUP, Corpus
from . import fm

#: Bytes of a suffix compared at first for the order of suffixes.
PREFIX = 64


def _tails(corpus: Corpus) -> set[int]:
    return {0, *corpus.sep}


def _halo(corpus: Corpus, size: int) -> DataFrame:
    """ord, halo: the ``size`` bytes after a document and its tail, round the corpus' end (as a view).

    Each document shows its first bytes only. Within a group of neighbouring documents a window of at
    most ``size`` rows gathers them; a group's end reads on in the next groups' heads.
    """
    whole = corpus.rows.select("ord", F.floor(F.col("ord") / GROUP).alias("g"), F.left(F.concat(view("body"), view("tail")), F.lit(size)).alias("head")).where("head <> ''")
    after = Window.partitionBy("g").orderBy("ord").rowsBetween(1, size)
    local = whole.select("ord", "g", F.left(F.array_join(F.collect_list("head").over(after), ""), F.lit(size)).alias("halo"))
    first = Window.partitionBy("g").orderBy("ord")
    heads = whole.withColumn("k", F.row_number().over(first)).where(F.col("k") <= size).groupBy("g").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "head"))), lambda x: x["head"]), ""), F.lit(size)).alias("head"))
    # one row a group of documents; the corpus' start follows its end
    start = corpus.rows.orderBy("ord").limit(size).select("ord", F.left(F.concat(view("body"), view("tail")), F.lit(size)).alias("head")).where("head <> ''")
    start = start.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "head"))), lambda x: x["head"]), "").alias("s"))
    wrap = start.select(F.left(F.repeat("s", F.lit(size) / F.greatest(F.length("s"), F.lit(1)) + 1), F.lit(size)).alias("wrap"))
    later = Window.orderBy("g").rowsBetween(1, size)
    ends = heads.select("g", F.array_join(F.collect_list("head").over(later), "").alias("rest")).crossJoin(F.broadcast(wrap)).select("g", F.left(F.concat("rest", "wrap"), F.lit(size)).alias("rest"))
    near = corpus.rows.select("ord", F.floor(F.col("ord") / GROUP).alias("g")).join(local.select("ord", "halo"), "ord", "left")
    return near.join(ends, "g").select("ord", F.left(F.concat(F.coalesce("halo", F.lit("")), "rest"), F.lit(size)).alias("halo"))


def _scanned(corpus: Corpus, m: Matcher, placed: bool) -> DataFrame:
    """Documents with ``own`` (bytes in which matches may start) and ``seen`` (bytes to look at)."""
    base = corpus.df if placed else corpus.rows
    if not (m.accepts & _tails(corpus)):
        return base.withColumn("own", view("body")).withColumn("seen", F.col("own"))
    base = base.withColumn("own", F.concat(view("body"), view("tail")))
    if m.max_len < 2:
        return base.withColumn("seen", F.col("own"))
    return base.join(_halo(corpus, m.max_len - 1), "ord").withColumn("seen", F.concat("own", "halo"))


def _hits(m: Matcher) -> Column:
    """Match starts in ``own``: those in ``seen`` without those that start beyond ``own``."""
    count = lambda c: F.regexp_count(c, F.lit(m.ahead))
    n = count(F.col("seen")) - F.when(F.length("seen") > F.length("own"), count(F.substring("seen", F.length("own") + 1, F.length("seen")))).otherwise(0)
    if m.literal and not m.nullable:
        return F.when(F.contains("seen", F.lit(m.literal)), n).otherwise(0).cast("long")
    return n.cast("long")


def doc_counts(corpus: Corpus, m: Matcher) -> DataFrame:
    """doc_id, n: match starts in each document and its tail."""
    if m.nullable:
        return corpus.rows.select("doc_id", (F.octet_length("body") + F.octet_length("tail")).cast("long").alias("n"))
    return _scanned(corpus, m, False).select("doc_id", _hits(m).alias("n"))


def count(corpus: Corpus, m: Matcher) -> DataFrame:
    """One row: n."""
    return doc_counts(corpus, m).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def count_many(corpus: Corpus, matchers: dict[str, Matcher]) -> DataFrame:
    """pattern, n: all patterns in one pass; each is an expression, compiled once a task."""
    inner = {k: m for k, m in matchers.items() if not m.nullable and not (m.accepts & _tails(corpus))}
    out = None
    if inner:
        rows = corpus.rows.withColumn("own", view("body")).withColumn("seen", F.col("own"))
        sums = rows.agg(*(F.coalesce(F.sum(_hits(m)), F.lit(0)).alias(f"n{k}") for k, m in enumerate(inner.values())))
        out = sums.select(F.explode(F.array(*(F.struct(F.lit(name).alias("pattern"), F.col(f"n{k}").alias("n")) for k, name in enumerate(inner)))).alias("x")).select("x.*")
    for k, m in matchers.items():
        if k not in inner:
            one = count(corpus, m).select(F.lit(k).alias("pattern"), "n")
            out = one if out is None else out.unionAll(one)
    return out


def positions(corpus: Corpus, m: Matcher) -> DataFrame:
    """doc_id, ord, local, pos: each match start, in its document and in the corpus."""
    if m.nullable:
        end = F.col("byte_len") + F.octet_length("tail") - 1
        return corpus.df.where(end >= 0).select("doc_id", "ord", "start", F.explode(F.sequence(F.lit(0).cast("long"), end)).alias("local")).select("doc_id", "ord", "local", (F.col("start") + F.col("local")).alias("pos"))
    rows = _scanned(corpus, m, True)
    if m.literal:
        rows = rows.where(F.contains("seen", F.lit(m.literal)))
    # the text is cut at each start; a start at 0 leaves no piece before it
    pieces = rows.select("doc_id", "ord", "start", F.length("own").alias("size"), F.rlike("seen", F.lit(f"\\A(?:{m.java})")).alias("zero"), F.split("seen", m.ahead, -1).alias("p"))
    cut = pieces.select("doc_id", "ord", "start", "size", "zero", F.posexplode(F.transform("p", F.length)).alias("k", "len"))
    before = Window.partitionBy("ord").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("local", F.coalesce(F.sum("len").over(before), F.lit(0)))
    return placed.where(((F.col("k") > 0) | F.col("zero")) & (F.col("local") < F.col("size"))).select("doc_id", "ord", "local", (F.col("start") + F.col("local")).alias("pos"))


def locate(corpus: Corpus, m: Matcher, limit: int = 0, found: DataFrame | None = None) -> DataFrame:
    """Positions (``found``, if they are known); with a limit, the first ones in the order of the suffixes that start there.

    Suffixes are compared by ``PREFIX`` bytes first, which leaves little more than ``limit`` rows; those
    by the rest of their document and the start of what follows, then by place.
    """
    found = positions(corpus, m) if found is None else found
    if limit <= 0:
        return found
    texts = corpus.df.select("ord", F.concat(view("body"), view("tail")).alias("own")).join(_halo(corpus, PREFIX), "ord").select("ord", F.concat("own", "halo").alias("seen"))
    keyed = found.join(texts, "ord").withColumn("key", F.substring("seen", (F.col("local") + 1).cast("int"), F.lit(PREFIX)))
    edge = keyed.select("key").orderBy("key").limit(limit).agg(F.max("key").alias("edge"))
    near = keyed.crossJoin(F.broadcast(edge)).where("key <= edge")  # one row
    return near.withColumn("rest", F.substring("seen", (F.col("local") + 1).cast("int"), F.length("seen"))).orderBy("rest", F.desc("pos")).limit(limit).select("doc_id", "ord", "local", "pos")


@dataclass
class Result:
    """total_count and truncated as one row; positions in ascending order."""

    summary: DataFrame
    positions: DataFrame


def search(corpus: Corpus, pattern: str, limit: int = 0, index: DataFrame | None = None) -> Result:
    """A star-free regular expression: count before the limit, whether it cut, positions."""
    tree = check(pattern)
    return _result(corpus, compile_tree(tree), limit, index, program(tree))


def search_literal(corpus: Corpus, pattern: str | bytes, limit: int = 0, backend: str = "fm", compat: bool = False, index: DataFrame | None = None) -> Result:
    """A byte string. The suffix-array backend finds nothing for the empty one; ``compat`` calls a
    result of exactly ``limit`` positions truncated, as the literal backends of the command line do."""
    m = compile_literal(pattern)
    if m.nullable and backend == "suffixarray":
        none = corpus.df.select("doc_id", "ord", F.lit(0).cast("long").alias("local"), F.col("start").alias("pos")).limit(0)
        return Result(none.agg(F.count("*").alias("total_count"), F.lit(False).alias("truncated")), none)
    out = _result(corpus, m, limit, index, literal_program(pattern))
    if compat and limit > 0:
        out.summary = out.summary.withColumn("truncated", F.col("total_count") >= limit)
    return out


def _result(corpus: Corpus, m: Matcher, limit: int, index: DataFrame | None = None, steps: Program = ()) -> Result:
    """By the index if there is one and it can answer the pattern, else by a scan."""
    use = index is not None and not m.nullable and not m.accepts & _tails(corpus)
    found = fm.positions(index, steps, m.accepts) if use else None
    total = (fm.count(index, steps, m.accepts) if use else count(corpus, m)).select(F.col("n").alias("total_count"), ((F.col("n") > limit) & F.lit(limit > 0)).alias("truncated"))
    return Result(total, locate(corpus, m, limit, found).orderBy("pos"))


def snippets(corpus: Corpus, found: DataFrame, pat_len: int, around: int) -> DataFrame:
    """pos, snippet for positions: the text around each, within its document, on whole characters."""
    texts = corpus.df.select("ord", view("body").alias("seen"))
    return found.join(texts, "ord").select("doc_id", "pos", context(F.col("seen"), F.col("local"), pat_len, around).alias("snippet"))
