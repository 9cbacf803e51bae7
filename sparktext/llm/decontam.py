"""Operator 4: benchmark decontamination with suffix arrays of the training documents.

Each chunk of documents is a shard with its own suffix array over words, sorted to the depth of a window
(``window`` words) by prefix doubling. Every suffix of every test item is searched in it by binary search
(an item of fewer words than a window is one window); hits that follow each other in document and
item are one verbatim match, of which the longest per document and all places are given.

Test items are a stated query set, searched in blocks: slices of about ``SLICE_BYTES`` dealt by a hash of the item's
id, each broadcast for one pass over the documents and dropped after it, so no broadcast grows with the test
set. With several slices their hits (rows of documents that are hit, not of all) are joined by doc_id and the
digest of the text, so rows that differ in either are told apart and equal rows get equal results.

Edge cases: null or wordless documents have no words and are never contaminated; null or wordless
items have no window; rows with the same item id are one item; items without an id are one item, which
has no name in the list; rows with the same or no doc_id in the documents are each reported. Extra columns
are ignored. Empty tables give no rows / no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, map_chunks, table

SLICE_BYTES = 16 << 20
#: Pairs of places (in a document and in an item) that are looked at together.
PAIRS = 2_000_000

#: A-Z become a-z; what is not a letter, digit or a byte beyond ASCII parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text's bytes, A-Z lower-cased."""
    return data.translate(_TABLE).split() if data else []


class Items:
    """A slice of test items: their words as numbers, one after the other with -1 between."""

    def __init__(self, items: list[tuple], window: int = 8):
        self.vocab: dict[bytes, int] = {}
        ids: dict[object, int] = {}
        flat, owner, size = [], [], []
        for i, t in items:
            w = words_of(t)
            if w:
                flat += [self.vocab.setdefault(x, len(self.vocab)) for x in w] + [-1]
                owner += [ids.setdefault(i, len(ids))] * (len(w) + 1)
                size += [min(window, len(w))] * (len(w) + 1)
        self.ids = [None if i is None else str(i) for i in ids]
        self.flat, self.owner, self.size = (np.array(x, np.int64) for x in (flat, owner, size))

    def numbers(self, known: dict[bytes, int]) -> np.ndarray:
        """The items' words by a shard's numbers; -1 for words that the shard doesn't have."""
        to = np.array([*(known.get(x, -1) for x in self.vocab), -1], np.int64)
        return to[self.flat]


class SuffixArray:
    """Suffixes of a shard (word numbers, -1 after each document), in order to a depth of some words."""

    def __init__(self, ids: np.ndarray):
        self.ranks, self.tables = {1: ids}, {}

    @staticmethod
    def _keys(rank: np.ndarray, half: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places at which n words stand, and their first and last ``half`` words as one number."""
        gap = n - half
        a, b = rank[: max(0, len(rank) - gap)], rank[gap:]
        at = np.flatnonzero((a >= 0) & (b >= 0))
        return at, (a[at] << 31) | b[at]

    def sorted(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all groups of n words in order, and the places where they stand."""
        if n not in self.tables:
            if n == 1:
                at = np.flatnonzero(self.ranks[1] >= 0)
                keys = self.ranks[1][at]
            else:
                half = 1 << ((n - 1).bit_length() - 1)
                at, keys = self._keys(self.rank(half), half, n)
            by = np.argsort(keys, kind="stable")
            self.tables[n] = keys[by], at[by]
        return self.tables[n]

    def rank(self, n: int) -> np.ndarray:
        """Rank of the n words at each place among the shard's groups, -1 where a document ends before."""
        if n not in self.ranks:
            keys, at = self.sorted(n)
            out = np.full(len(self.ranks[1]), -1, np.int64)
            out[at] = np.cumsum(np.diff(keys, prepend=-1) != 0) - 1
            self.ranks[n] = out
            self.tables[n] = keys, at
        return self.ranks[n]

    def find(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each group of n words of a query lies in the order of ``sorted(n)``: [lo, hi)."""
        lo = hi = np.zeros(len(ids), np.int64)
        rank, have = ids, 1
        while have < n:
            step = min(2 * have, n)
            at, keys = self._keys(rank, have, step)
            table_, _ = self.sorted(step)
            low, high = np.searchsorted(table_, keys, "left"), np.searchsorted(table_, keys, "right")
            if step == n:
                lo, hi = np.zeros((2, len(ids)), np.int64)
                lo[at], hi[at] = low, high
                return lo, hi
            rank = np.full(len(ids), -1, np.int64)
            hit = high > low
            rank[at[hit]] = self.rank(step)[self.sorted(step)[1][low[hit]]]
            have = step
        at = np.flatnonzero(ids >= 0)
        lo, hi = np.zeros((2, len(ids)), np.int64)
        lo[at], hi[at] = (np.searchsorted(self.sorted(1)[0], ids[at], side) for side in ("left", "right"))
        return lo, hi


class Shard:
    """A chunk of documents as words, one after the other with -1 between, and its suffix array."""

    def __init__(self, texts: list):
        self.known: dict[bytes, int] = {}
        add, flat, counts = self.known.setdefault, [], []
        for t in texts:
            w = words_of(t)
            counts.append(len(w))
            flat += [add(x, len(self.known)) for x in w]
            flat.append(-1)
        self.counts = np.array(counts, np.int64)
        self.ids = np.array(flat, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts + 1)])
        self.suffixes = SuffixArray(self.ids)

    def hits(self, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (window length, document places, item places) of all hits, whole documents at a time (a
        document of more than ``PAIRS`` pairs in parts of whole items)."""
        query = items.numbers(self.known)
        for n in np.unique(items.size).tolist():
            lo, hi = self.suffixes.find(query, n)
            q = np.flatnonzero((hi > lo) & (items.size == n))
            if not len(q):
                continue
            # equal windows of items have one interval; places by interval, in order of documents
            q = q[np.argsort(lo[q], kind="stable")]
            first = np.flatnonzero(np.diff(lo[q], prepend=-1))
            begin, many = first, np.diff(np.append(first, len(q)))
            size = (hi - lo)[q[first]]
            kind = np.repeat(np.arange(len(first)), size)
            inside = np.arange(len(kind)) - np.repeat(np.cumsum(size) - size, size)
            p = self.suffixes.sorted(n)[1][lo[q[first]][kind] + inside]
            by = np.argsort(p)
            p, kind = p[by], kind[by]
            doc = np.searchsorted(self.starts, p, "right") - 1
            edge = np.flatnonzero(np.diff(doc, append=-1)) + 1
            total = np.cumsum(many[kind])[edge - 1]
            at = 0
            while at < len(edge):
                before, low = (total[at - 1], edge[at - 1]) if at else (0, 0)
                to = max(at + 1, int(np.searchsorted(total, before + PAIRS, "right")))
                x, y = p[low : edge[to - 1]], kind[low : edge[to - 1]]
                at = to
                if total[to - 1] - before <= PAIRS:
                    row = np.repeat(np.arange(len(x)), many[y])
                    off = np.arange(len(row)) - np.repeat(np.cumsum(many[y]) - many[y], many[y])
                    yield n, x[row], q[begin[y][row] + off]
                    continue
                # one document with very many pairs: its items in parts
                times = np.bincount(y, minlength=len(first))
                weight = np.repeat(times, many)
                use = np.flatnonzero(weight)
                use = use[np.argsort(items.owner[q[use]], kind="stable")]
                owner, part = items.owner[q[use]], np.cumsum(weight[use]) // PAIRS
                part = part[np.searchsorted(owner, owner, "left")]  # an item is in one part
                of = np.repeat(np.arange(len(first)), many)
                order = np.argsort(y, kind="stable")
                start = np.concatenate([[0], np.cumsum(times)])
                for k in np.unique(part).tolist():
                    mine = use[part == k]
                    m = times[of[mine]]
                    row = np.repeat(np.arange(len(mine)), m)
                    off = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
                    yield n, x[order[start[of[mine]][row] + off]], q[mine][row]


def search(items: Items, texts: list):
    """Of a chunk of documents: the shard, which words are hit, (document, item) pairs, and the verbatim
    matches (document, start, item, start in the item's row, words)."""
    shard = Shard(texts)
    edge = np.zeros(len(shard.ids) + 1, np.int32)
    pairs, matches = [np.zeros(0, np.int64)], [np.zeros((0, 5), np.int64)]
    # where the item row of each place starts
    row = np.concatenate([[0], np.flatnonzero(items.flat < 0) + 1])
    for n, at, q in shard.hits(items):
        here = np.unique(at)
        edge[here] += 1
        edge[here + n] -= 1
        doc, owner = np.searchsorted(shard.starts, at, "right") - 1, items.owner[q]
        pairs.append(np.unique((doc << 32) | owner))
        # hits one after the other in document and item are one match
        by = np.lexsort((at, at - q))
        a, d = at[by], (at - q)[by]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 0) | (np.diff(a) != 1)]))
        size = np.diff(np.append(new, len(a))) + n - 1
        o = by[new]
        matches.append(np.stack([doc[o], at[o] - shard.starts[doc[o]], owner[o], q[o] - row[np.searchsorted(row, q[o], "right") - 1], size], 1))
    matches = np.concatenate(matches)
    return shard, np.cumsum(edge[:-1]) > 0, np.unique(np.concatenate(pairs)), matches[np.lexsort(matches.T[::-1])]


def _lists(doc: np.ndarray, n: int, *values: np.ndarray) -> list[list]:
    cut = np.searchsorted(doc, np.arange(n + 1))
    return [[v[cut[k] : cut[k + 1]].tolist() for k in range(n)] for v in values]


def slices(items: DataFrame, text: str = "text", key: str = "item_id", limit: int = SLICE_BYTES) -> Iterator[list[tuple]]:
    """Test items in slices of about ``limit`` bytes of text, one after the other; rows of one id are in one slice."""
    rows = items.select(F.col(key).alias("i"), F.encode(text, "UTF-8").alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = int(size) // limit + 1
    for k in range(n):
        yield [(r[0], None if r[1] is None else bytes(r[1])) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()]


_FOUND = "doc_id long, sha string, n_words long, starts array<long>, ends array<long>, items array<string>, longest long, matches array<struct<start:long,item:string,item_start:long,words:long>>"


def find_items(docs: DataFrame, items: DataFrame, window: int = 8, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", limit: int = SLICE_BYTES) -> DataFrame:
    """Per document: n_words, hit words (spans: starts, ends), the ids of items with windows in it, the
    longest verbatim match in words, and all matches (start, item, start in the item, words)."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("t"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha"))

    def searched(part: list[tuple], every: bool):
        held = spark.sparkContext.broadcast(Items(part, window))

        def run(cols):
            it, n = held.value, len(cols[0])
            shard, covered, pairs, matches = search(it, cols[1])
            flips = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
            doc = np.searchsorted(shard.starts, flips[::2], "right") - 1
            a, b = _lists(doc, n, flips[::2] - shard.starts[doc], flips[1::2] - shard.starts[doc])
            names = [[it.ids[o] for o in x] for x in _lists(pairs >> 32, n, pairs & 0xFFFFFFFF)[0]]
            found = [[{"start": s, "item": it.ids[o], "item_start": q, "words": z} for s, o, q, z in zip(*x)] for x in zip(*_lists(matches[:, 0], n, *matches[:, 1:].T))]
            longest = [max((m["words"] for m in x), default=0) for x in found]
            keep = [k for k in range(n) if every or a[k]]
            t = pa.list_(pa.int64())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("item", pa.string()), ("item_start", pa.int64()), ("words", pa.int64())]))
            cols_ = (cols[0], pa.int64()), (cols[2], pa.string()), (shard.counts.tolist(), pa.int64()), (a, t), (b, t), (names, pa.list_(pa.string())), (longest, pa.int64()), (found, kind)
            return pa.RecordBatch.from_arrays([pa.array([v[k] for k in keep], z) for v, z in cols_], names=["doc_id", "sha", "n_words", "starts", "ends", "items", "longest", "matches"])

        return map_chunks(source, run, _FOUND), held

    parts = slices(items, item_text, item_key, limit)
    part, after = next(parts), next(parts, None)
    found, held = searched(part, True)
    if after is None:
        return found.drop("sha")
    every = found = table(found, "searched")
    held.unpersist()
    while after is not None:
        more, held = searched(after, False)
        more = table(more, "searched")
        held.unpersist()
        found = found.unionAll(more)
        after = next(parts, None)
    # equal rows have equal hits: one of them stands for all
    once = found.where(F.size("starts") > 0).dropDuplicates(["doc_id", "sha", "items"])
    joined = once.groupBy("doc_id", "sha").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.max("longest").alias("longest"), F.flatten(F.collect_list("matches")).alias("matches"))
    # spans that overlap or touch are one
    spans = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<starts:bigint,ends:bigint>>"),
        lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["ends"] >= x["starts"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["starts"].alias("starts"), F.greatest(F.element_at(out, -1)["ends"], x["ends"]).alias("ends"))))).otherwise(F.concat(out, F.array(x))),
    )
    joined = joined.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), spans.alias("spans"), F.col("items").alias("all_items"), F.col("longest").alias("most"), F.col("matches").alias("all_matches"))
    rows = every.select("doc_id", "sha", "n_words").join(joined, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("sha").eqNullSafe(F.col("_sha")), "left")
    empty = F.array()
    return rows.select("doc_id", "n_words", *(F.coalesce(F.col(c), empty.cast(kind)).alias(n) for c, n, kind in (("spans.starts", "starts", "array<long>"), ("spans.ends", "ends", "array<long>"), ("all_items", "items", "array<string>"))), F.coalesce("most", F.lit(0)).alias("longest"), F.coalesce("all_matches", empty.cast("array<struct<start:long,item:string,item_start:long,words:long>>")).alias("matches"))


def _hit():
    return F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def contamination(docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 2, **names) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (n_items >= min_items), longest_match."""
    found = find_items(docs, items, window, **names)
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", _hit().alias("n_hit"), n.alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n >= min_items).alias("contaminated"), F.col("longest").alias("longest_match"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 1, min_share: float = 0.0, short_share: float = 0.0, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """The documents without those that hold windows of at least ``min_items`` items and whose hit
    share is at least ``min_share``; where no item of a whole window is hit, only shorter ones, the hit
    share must be at least ``short_share``, as short items may be common words. Each row is judged by its text alone. With one slice of items documents are searched and
    removed in one pass; with several, distinct digests of the texts that go are joined."""
    spark = docs.sparkSession
    parts = slices(items, limit=limit)
    part = next(parts)
    if (after := next(parts, None)) is not None:
        parts.close()
        rows = docs.select(F.sha2(F.encode(text, "UTF-8"), 256).alias("sha"), F.col(text).alias("text")).where("text is not null").dropDuplicates(["sha"]).select(F.xxhash64("sha").alias("doc_id"), "text")
        del after
        found = find_items(rows.select("doc_id", "text"), items, window, limit=limit)
        bad = table(found.where((F.size("items") >= min_items) & (_hit() >= min_share * F.col("n_words")) & ((F.col("longest") >= window) | (_hit() >= short_share * F.col("n_words")))).select(F.col("doc_id").alias("_gone")).distinct(), "contaminated")
        # a text is named by 64 bits of its digest
        return docs.join(bad, F.xxhash64(F.sha2(F.encode(docs[text], "UTF-8"), 256)) == bad["_gone"], "left_anti")
    held = spark.sparkContext.broadcast(Items(part, window))

    def run(batches):
        it = held.value
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                rows = b.slice(k, 4096)
                texts = [t.encode() if t is not None else None for t in rows.column(rows.schema.get_field_index(text)).to_pylist()]
                shard, covered, pairs, matches = search(it, texts)
                n_items = np.bincount(pairs >> 32, minlength=len(texts))
                longest = np.zeros(len(texts), np.int64)
                np.maximum.at(longest, matches[:, 0], matches[:, 4])
                total = np.concatenate([[0], np.cumsum(covered)])
                hit = total[shard.starts[1:]] - total[shard.starts[:-1]]
                keep = (n_items < min_items) | (hit < min_share * shard.counts) | ((longest < window) & (hit < short_share * shard.counts))
                yield rows.filter(pa.array(keep))

    return map_arrow(docs, run, docs.schema)
