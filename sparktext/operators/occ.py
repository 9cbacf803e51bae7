"""Rank (occurrence) structures: eight encodings of one function, rank(byte, i) = occurrences of a byte
in the first i places of a shard's transform.

Each encoder turns the suffix table into a small table, and answers a table of questions (shard, byte,
i) by a join; answers are equal for all encodings. i is clamped to the transform; absent bytes
have rank 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .suffix import runs


def _questions(sa: DataFrame, asked: DataFrame) -> DataFrame:
    """shard, byte, i, and at: i clamped to 0..n."""
    n = sa.groupBy("shard").agg(F.count("*").alias("n_all"))
    return asked.join(F.broadcast(n), "shard").withColumn("at", F.greatest(F.lit(0), F.least("i", "n_all")).cast("long")).select("shard", "byte", "i", "at")


def _last_before(table: DataFrame, asked: DataFrame, place: str, values: list[str]) -> DataFrame:
    """Questions with the values of the last row of their (shard, byte) whose ``place`` is below ``at``:
    an as-of join by one sort of both, without a range join."""
    left = table.select("shard", "byte", F.col(place).alias("p"), F.lit(None).cast("long").alias("i"), F.struct(*([place] + values)).alias("v"))
    right = asked.select("shard", "byte", F.col("at").alias("p"), "i", F.lit(None).cast(left.schema["v"].dataType).alias("v"))
    w = Window.partitionBy("shard", "byte").orderBy("p", F.col("i").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionAll(right).withColumn("last", F.last("v", ignorenulls=True).over(w))
    return both.where("i is not null").select("shard", "byte", "i", F.col("p").alias("at"), "last.*")


def _spread(cond, value) -> F.Column:
    return F.sum(F.when(cond, value).otherwise(0))


def bitvectors(sa: DataFrame) -> DataFrame:
    """A word of 64 bits for each 64 places that hold the byte, and the ones before it."""
    words = sa.groupBy("shard", F.col("bwt").cast("int").alias("byte"), F.floor(F.col("rank") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(rank % 64 as int))")).alias("bits"))
    w = Window.partitionBy("shard", "byte").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("cum", F.coalesce(F.sum(F.bit_count("bits")).over(w), F.lit(0)))


def rank_bitvectors(sa: DataFrame, asked: DataFrame) -> DataFrame:
    table = bitvectors(sa).withColumn("first", F.col("word") * 64)
    found = _last_before(table, _questions(sa, asked), "first", ["bits", "cum"])
    inside = F.col("at") - F.col("first")
    kept = F.when(inside >= 64, F.bit_count("bits")).otherwise(F.bit_count(F.expr("bits & ~shiftleft(-1L, cast(at - first as int))")))
    return found.select("shard", "byte", "i", F.coalesce(F.col("cum") + kept, F.lit(0)).cast("long").alias("rank"))


def wavelet_tree(sa: DataFrame) -> DataFrame:
    """Eight levels: at each, a place's node (its byte's upper bits), its place in the node, its next bit
    and the ones before it in the node."""
    out = None
    for level in range(8):
        node, bit = F.floor(F.col("bwt") / (1 << (8 - level))).cast("int"), F.floor(F.col("bwt") / (1 << (7 - level))).cast("int") % 2
        base = sa.select("shard", "rank", F.lit(level).alias("level"), node.alias("node"), bit.alias("bit"))
        w = Window.partitionBy("shard", "level", "node").orderBy("rank")
        one = base.select("shard", "level", "node", (F.row_number().over(w).cast("long") - 1).alias("k"), "bit", (F.sum("bit").over(w) - F.col("bit")).alias("ones"))
        out = one if out is None else out.unionAll(one)
    return out


def rank_wavelet_tree(sa: DataFrame, asked: DataFrame) -> DataFrame:
    table = wavelet_tree(sa)
    # the value at the end of a node, so that questions one past the last place find it
    ends = table.groupBy("shard", "level", "node").agg((F.max("k") + 1).alias("k"), F.sum("bit").cast("long").alias("ones"))
    steps = table.select("shard", "level", "node", "k", "ones").unionAll(ends)
    now = _questions(sa, asked)
    for level in range(8):
        at = steps.where(F.col("level") == level).drop("level")
        byte = now.withColumn("node", F.floor(F.col("byte") / (1 << (8 - level))).cast("int")).withColumn("bit", F.floor(F.col("byte") / (1 << (7 - level))).cast("int") % 2)
        joined = byte.join(at, (byte["shard"] == at["shard"]) & (byte["node"] == at["node"]) & (byte["at"] == at["k"]), "left")
        now = joined.select(byte["shard"], byte["byte"], byte["i"], F.coalesce(F.when(F.col("bit") == 1, F.col("ones")).otherwise(F.col("at") - F.col("ones")), F.lit(0)).alias("at"))
    return now.select("shard", "byte", "i", F.col("at").cast("long").alias("rank"))


def wavelet_matrix(sa: DataFrame) -> DataFrame:
    """Eight bit planes, highest first; each plane stably puts zeros before ones. Rows: level, k (place
    in the plane), bit, ones before; zeros of the plane."""
    now = sa.select("shard", F.col("rank").alias("k"), F.col("bwt").cast("int").alias("b"))
    out = None
    for level in range(8):
        bit = F.floor(F.col("b") / (1 << (7 - level))).cast("int") % 2
        now = now.withColumn("bit", bit)
        w = Window.partitionBy("shard").orderBy("k")
        plane = now.withColumn("ones", F.sum("bit").over(w) - F.col("bit")).withColumn("zeros", F.sum(1 - F.col("bit")).over(Window.partitionBy("shard")))
        one = plane.select("shard", F.lit(level).alias("level"), "k", "bit", "ones", "zeros")
        out = one if out is None else out.unionAll(one)
        to = F.when(F.col("bit") == 0, F.col("k") - F.col("ones")).otherwise(F.col("zeros") + F.col("ones"))
        now = plane.select("shard", to.alias("k"), "b")
    return out


def rank_wavelet_matrix(sa: DataFrame, asked: DataFrame) -> DataFrame:
    table = wavelet_matrix(sa)
    ends = table.groupBy("shard", "level").agg((F.max("k") + 1).alias("k"), F.sum("bit").cast("long").alias("ones"), F.max("zeros").alias("zeros"))
    steps = table.select("shard", "level", "k", "ones", "zeros").unionAll(ends)
    now = _questions(sa, asked).withColumn("lo", F.lit(0).cast("long"))
    for level in range(8):
        at = steps.where(F.col("level") == level).select("shard", "k", "ones", "zeros")
        bit = F.floor(F.col("byte") / (1 << (7 - level))).cast("int") % 2
        lo, hi = at.select("shard", F.col("k").alias("lo"), F.col("ones").alias("lo1"), "zeros"), at.select("shard", F.col("k").alias("at"), F.col("ones").alias("hi1"))
        j = now.join(lo, ["shard", "lo"]).join(hi, ["shard", "at"])
        now = j.select("shard", "byte", "i", F.when(bit == 1, F.col("zeros") + F.col("lo1")).otherwise(F.col("lo") - F.col("lo1")).alias("lo"), F.when(bit == 1, F.col("zeros") + F.col("hi1")).otherwise(F.col("at") - F.col("hi1")).alias("at"))
    return now.select("shard", "byte", "i", (F.col("at") - F.col("lo")).cast("long").alias("rank"))


def rank_rlbwt(sa: DataFrame, asked: DataFrame) -> DataFrame:
    """Runs: the last run of the byte that starts before i gives what came before and what of it counts."""
    found = _last_before(runs(sa), _questions(sa, asked), "start", ["len", "cum_before"])
    return found.select("shard", "byte", "i", F.coalesce(F.col("cum_before") + F.least(F.col("len"), F.col("at") - F.col("start")), F.lit(0)).cast("long").alias("rank"))


#: Bits of a block of the compressed vectors.
BLOCK = 15


def _binomials():
    """Binomial coefficients up to BLOCK as a map literal, by 16 * n + k."""
    import math

    return F.create_map(*(F.lit(x) for n in range(BLOCK + 1) for k in range(n + 1) for x in (16 * n + k, math.comb(n, k))))


def rrr(sa: DataFrame) -> DataFrame:
    """Per byte and block of 15 places: class (ones) and offset (its number among blocks of the class),
    and the ones before the block."""
    blocks = sa.groupBy("shard", F.col("bwt").cast("int").alias("byte"), F.floor(F.col("rank") / BLOCK).alias("block")).agg(F.count("*").cast("int").alias("class"), F.array_sort(F.collect_list((F.col("rank") % BLOCK).cast("int"))).alias("at"))
    table = _binomials()
    # combinatorial number: the k-th one at place p counts C(p, k + 1)
    offset = F.aggregate(F.transform("at", lambda p, k: F.coalesce(F.element_at(table, 16 * p + k + 1), F.lit(0))), F.lit(0), lambda a, x: a + x)
    w = Window.partitionBy("shard", "byte").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("shard", "byte", "block", "class", offset.alias("offset"), F.coalesce(F.sum("class").over(w), F.lit(0)).alias("cum"))


def _ones_below(limit, cls, offset):
    """Ones below ``limit`` in a block given by class and offset: the places are read off the offset
    from the highest one down (greedy combinatorial numbers)."""
    table = _binomials()
    places = F.sequence(F.lit(BLOCK - 1), F.lit(0), F.lit(-1))
    start = F.struct(cls.cast("int").alias("left"), offset.cast("int").alias("rest"), F.lit(0).alias("n"))

    def step(a, p):
        c = F.coalesce(F.element_at(table, 16 * p + a["left"]), F.lit(0))
        one = (a["left"] > 0) & (a["rest"] >= c)
        return F.struct((a["left"] - one.cast("int")).alias("left"), (a["rest"] - F.when(one, c).otherwise(0)).alias("rest"), (a["n"] + (one & (p < limit)).cast("int")).alias("n"))

    return F.aggregate(places, start, step, lambda a: a["n"])


def rank_rrr(sa: DataFrame, asked: DataFrame) -> DataFrame:
    table = rrr(sa).withColumn("first", F.col("block") * BLOCK)
    found = _last_before(table, _questions(sa, asked), "first", ["class", "offset", "cum"])
    n = _ones_below(F.least(F.lit(BLOCK), F.col("at") - F.col("first")), F.coalesce("class", F.lit(0)), F.coalesce("offset", F.lit(0)))
    return found.select("shard", "byte", "i", F.coalesce(F.col("cum") + n, F.lit(0)).cast("long").alias("rank"))


def elias_fano(sa: DataFrame) -> DataFrame:
    """Per byte its places: upper part, lower bits, and number in order; low bits are log2(n / m)."""
    n = sa.groupBy("shard").agg(F.count("*").alias("n"))
    m = sa.groupBy("shard", F.col("bwt").cast("int").alias("byte")).agg(F.count("*").alias("m"))
    size = m.join(F.broadcast(n), "shard").select("shard", "byte", F.floor(F.log2(F.greatest(F.col("n") / F.col("m"), F.lit(1.0)))).cast("int").alias("low_bits"))
    w = Window.partitionBy("shard", "byte").orderBy("rank")
    placed = sa.select("shard", F.col("bwt").cast("int").alias("byte"), "rank").withColumn("k", F.row_number().over(w).cast("long") - 1)
    return placed.join(F.broadcast(size), ["shard", "byte"]).select("shard", "byte", "k", F.expr("shiftright(rank, low_bits)").alias("high"), F.expr("rank & (shiftleft(1L, low_bits) - 1)").alias("low"), "low_bits")


def rank_elias_fano(sa: DataFrame, asked: DataFrame) -> DataFrame:
    table = elias_fano(sa).withColumn("place", F.expr("shiftleft(high, low_bits) | low"))
    # places below i: the last place before i has number k
    found = _last_before(table, _questions(sa, asked), "place", ["k"])
    return found.select("shard", "byte", "i", F.coalesce(F.col("k") + 1, F.lit(0)).cast("long").alias("rank"))


#: Blocks of a superblock.
SUPER = 32


def poppy(sa: DataFrame) -> DataFrame:
    """Compressed blocks, class and offset in one integer, with ones before the superblock and, within
    it, before the block."""
    base = rrr(sa).withColumn("super", F.floor(F.col("block") / SUPER))
    inner = Window.partitionBy("shard", "byte", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.expr("class | shiftleft(offset, 8)")
    return base.withColumn("inner", F.coalesce(F.sum("class").over(inner), F.lit(0))).select("shard", "byte", "block", "super", entry.alias("entry"), (F.col("cum") - F.col("inner")).alias("outer"), "inner")


def rank_poppy(sa: DataFrame, asked: DataFrame) -> DataFrame:
    table = poppy(sa).withColumn("first", F.col("block") * BLOCK)
    found = _last_before(table, _questions(sa, asked), "first", ["entry", "outer", "inner"])
    n = _ones_below(F.least(F.lit(BLOCK), F.col("at") - F.col("first")), F.coalesce(F.expr("entry & 255"), F.lit(0)), F.coalesce(F.expr("shiftright(entry, 8)"), F.lit(0)))
    return found.select("shard", "byte", "i", F.coalesce(F.col("outer") + F.col("inner") + n, F.lit(0)).cast("long").alias("rank"))


def dynamic(sa: DataFrame) -> DataFrame:
    """A Fenwick tree over the words: node j sums the words (j - lowbit(j), j]. Only nodes with ones."""
    words = bitvectors(sa).select("shard", "byte", "word", "bits", F.bit_count("bits").alias("ones"))
    top = sa.groupBy("shard").agg((F.floor(F.max("rank") / 64) + 1).alias("words"))
    # the nodes that hold word w (counted from 1): w, w + lowbit(w), ...
    steps = F.sequence(F.lit(0), F.lit(40))
    nodes = F.aggregate(steps, F.array((F.col("word") + 1).cast("long")), lambda a, _: F.when(F.element_at(a, -1) <= F.col("words"), F.array_append(a, F.element_at(a, -1) + F.element_at(a, -1).bitwiseAND(-F.element_at(a, -1)))).otherwise(a))
    spread = words.join(F.broadcast(top), "shard").select("shard", "byte", "words", "ones", F.explode(nodes).alias("node")).where("node <= words")
    return spread.groupBy("shard", "byte", "node").agg(F.sum("ones").alias("sum"))


def rank_dynamic(sa: DataFrame, asked: DataFrame) -> DataFrame:
    tree = dynamic(sa)
    words = bitvectors(sa).select("shard", "byte", "word", "bits")
    questions = _questions(sa, asked).withColumn("word", F.floor(F.col("at") / 64))
    steps = F.sequence(F.lit(0), F.lit(40))
    path = F.aggregate(steps, F.array(F.col("word").cast("long")), lambda a, _: F.when(F.element_at(a, -1) > 0, F.array_append(a, F.element_at(a, -1) - F.element_at(a, -1).bitwiseAND(-F.element_at(a, -1)))).otherwise(a))
    full = questions.select("shard", "byte", "i", F.explode(path).alias("node")).join(tree, ["shard", "byte", "node"]).groupBy("shard", "byte", "i").agg(F.sum("sum").alias("before"))
    out = questions.join(full, ["shard", "byte", "i"], "left").join(words, ["shard", "byte", "word"], "left")
    inside = F.bit_count(F.expr("bits & ~shiftleft(-1L, cast(at % 64 as int))"))
    return out.select("shard", "byte", "i", (F.coalesce("before", F.lit(0)) + F.coalesce(inside, F.lit(0))).cast("long").alias("rank"))


#: Encodings by name: the answer to (shard, byte, i) questions.
RANK: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "bitvectors": rank_bitvectors,
    "wavelet-tree": rank_wavelet_tree,
    "wavelet-matrix": rank_wavelet_matrix,
    "rlbwt": rank_rlbwt,
    "rrr": rank_rrr,
    "elias-fano": rank_elias_fano,
    "poppy": rank_poppy,
    "dynamic-bitvectors": rank_dynamic,
}
#: Encodings by name: the stored table.
ENCODE = {"bitvectors": bitvectors, "wavelet-tree": wavelet_tree, "wavelet-matrix": wavelet_matrix, "rlbwt": runs, "rrr": rrr, "elias-fano": elias_fano, "poppy": poppy, "dynamic-bitvectors": dynamic}


def rank(sa: DataFrame, asked: DataFrame, occ: str = "rlbwt") -> DataFrame:
    """shard, byte, i, rank by an encoding; unknown names mean bit vectors."""
    return RANK.get(occ, rank_bitvectors)(sa, asked)
