"""Operator 5: substring deduplication with repeated-phrase automata.

A window is ``WIDTH`` consecutive words of one document; a window whose word sequence also starts
earlier (smaller doc_id, or earlier in the document) takes its words with it.

Recurring phrases of ``GRAM`` words are confirmed first (see ``repeats``: sampled so that every
recurring window holds one, its anchor). Documents are then streamed in chunks. A chunk's documents and
the confirmed phrases in them are one shard: the phrases are compiled to Aho-Corasick automata
(pyahocorasick) of at most ``PHRASES`` phrases, and the chunk's documents run through them, which finds
every place of every phrase, word for word: a word's number is written in letters of five bits, so nodes have few
branches. What the automata report is all that is known of a document from then on: a window belongs to the
reported phrase with the smallest hash in it, and a window without one is no candidate. A document passes
its chunk's automata only, however many phrases the corpus has. Each occurrence goes out once, with the
words of the windows that belong to it; rows of one phrase meet in one task, which compares their windows word for word and
finds those that were there before.

Skew: copies of whole texts are settled by their hash before. A window comes out once per chunk: those
seen earlier in the chunk are marked at once. Windows of a phrase met more than ``HOT`` times are dealt
in shares of ``SHARE`` neighbours, by the words all of them have; what is still more than ``HOT`` rows
of one name goes on as single windows (their words), whose first places a partial aggregation finds.

Edge cases: null texts have no words; rows with a null doc_id stay whole and mark nothing; rows that
share a doc_id are taken for one document (ranges are cut to each row's length); texts shorter than a
window lose nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from ._common import drop_tables, map_arrow, map_chunks, mix, table, tables

WIDTH, GRAM = 20, 8
#: Phrases of an automaton, and windows of an often met phrase that are dealt together.
PHRASES, SHARE = 100_000, 5
#: Bits of a letter of the automata.
LETTER = 5


class _Words:
    """Words of a chunk as numbers, and their 64-bit hashes."""

    def __init__(self, texts: list[bytes], joined: bool = False):
        known: dict[bytes, int] = {}
        add, flat, counts, parts = known.setdefault, [], [], []
        for t in texts:
            w = t.split()
            counts.append(len(w))
            flat += [add(x, len(known)) for x in w]
            if joined:
                parts.append(b" ".join(w))
        self.ids = np.array(flat, np.int32)
        self.ends = np.cumsum(counts).astype(np.int64)
        self.starts = self.ends - np.array(counts, np.int64)
        h64 = xxhash.xxh64_intdigest
        self.hash = np.array([h64(x) for x in known], np.uint64)[self.ids] if flat else np.zeros(0, np.uint64)
        if joined:  # all words with one space between, and where each starts
            self.text = b" ".join(x for x in parts if x)
            size = np.array([len(x) + 1 for x in known], np.int64)
            self.place = np.concatenate([[0], np.cumsum(size[self.ids])]) if flat else np.zeros(1, np.int64)


def _anchors(texts: list[bytes]):
    w = _Words(texts)
    if len(w.ids) < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = repeats.Anchors(w.hash, w.ends, WIDTH, GRAM).at
    return np.searchsorted(w.ends, at, "right"), repeats.gram_hashes(w.hash, GRAM)[at]


def automaton(phrases: set[str]) -> ahocorasick.Automaton:
    """The automaton of phrases, some letters a word."""
    auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for x in phrases:
        auto.add_word(x)
    auto.make_automaton()
    return auto


def occurrences(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where in a chunk's documents (words as numbers) any of the phrases starts whose words stand at ``at``."""
    if not len(at):
        return np.zeros(0, np.int64)
    width = max(1, -(-int(ids.max()).bit_length() // LETTER))
    letters = 48 + ((ids[:, None] >> (LETTER * np.arange(width - 1, -1, -1))) & ((1 << LETTER) - 1))
    text, size = letters.astype(np.uint8).tobytes().decode("ascii"), GRAM * width
    names = sorted({text[p : p + size] for p in (at * width).tolist()})
    found: list[np.ndarray] = []
    for k in range(0, len(names), PHRASES):
        auto = automaton(set(names[k : k + PHRASES]))
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e - s >= WIDTH:
                last = np.array([x for x, _ in auto.iter(text[s * width : e * width])], np.int64) + 1
                found.append(s + last[last % width == 0] // width - GRAM)  # others are no whole words
    return np.unique(np.concatenate([np.zeros(0, np.int64), *found]))


_OUT = "h long, doc_id long, p long, mask int, ctx binary"


def _again(ids: np.ndarray, start: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Whether each window (its first word's place in ``ids``, and the words before its phrase's place) has the words of
    one before it. Windows are sorted by a hash of their words and compared word for word."""
    out = np.zeros(len(start), bool)
    for b in np.unique(back).tolist():
        at = np.flatnonzero(back == b)
        rows = ids[start[at][:, None] + np.arange(WIDTH)]
        h = np.zeros(len(at), np.uint64)
        for k in range(WIDTH):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + rows[:, k].astype(np.uint64))
        by = np.argsort(h, kind="stable")
        near, same = h[by][1:] == h[by][:-1], (rows[by][1:] == rows[by][:-1]).all(1)
        if (near & ~same).any():  # other words of the same hash: sorted by the words themselves
            by = np.argsort(np.unique(rows, axis=0, return_inverse=True)[1].ravel(), kind="stable")
            same = (rows[by][1:] == rows[by][:-1]).all(1)
        out[at[by[1:][same]]] = True
    return out


def _windows(cols):
    """Of a chunk: occurrences (h, doc_id, place, which windows by their words before the place as bits,
    their words), and marks settled in the chunk: (h null, doc_id, start, words)."""
    order = sorted((k for k, t in enumerate(cols[1]) if t), key=lambda k: cols[0][k])
    w = _Words([cols[1][k] for k in order], True)
    at, lists = np.zeros(0, np.int64), []
    if len(w.ids) >= WIDTH:
        h = repeats.gram_hashes(w.hash, GRAM).view(np.int64)
        phrases = [s + np.flatnonzero(np.isin(h[s : e - GRAM + 1], np.array(cols[2][src], np.int64))) for src, s, e in zip(order, w.starts.tolist(), w.ends.tolist()) if e - s >= WIDTH]
        at = occurrences(w.ids, w.starts, w.ends, np.concatenate([np.zeros(0, np.int64), *phrases]))
        a = repeats.Anchors(w.hash, w.ends, WIDTH, GRAM, at)
        lo, hi = a.windows(at)
        lists = [x for src in order for x in cols[3][src]]
    t = pa.int64()
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], t), pa.array([], t), pa.array([], t), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["h", "doc_id", "p", "mask", "ctx"])
    # all windows, in the order of their places; those seen before in the chunk are marked
    many = np.maximum(hi - lo + 1, 0)
    row = np.repeat(np.arange(len(at)), many)
    back = np.repeat(hi, many) - (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    start = at[row] - back
    again = _again(w.ids, start, back)
    doc = np.searchsorted(w.ends, start, "right")
    ids = np.array([cols[0][k] for k in order], np.int64)
    # marked windows that overlap are one range
    m, d = start[again], doc[again]
    o = np.argsort(m, kind="stable")
    m, d = m[o], d[o]
    new = np.concatenate([[True], (np.diff(m) > WIDTH) | (np.diff(d) != 0)]) if len(m) else np.zeros(0, bool)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(m) - 1) if len(m) else np.zeros(0, np.int64)
    # the others go out with their anchor; those of hot anchors in shares
    row, back, start, doc = row[~again], back[~again], start[~again], doc[~again]
    key = h[at[row]]
    share = np.zeros(len(row), np.int64)
    if lists:
        hot = np.isin(key, np.unique(np.array(lists, np.int64)))
        share[hot] = back[hot] // SHARE + 1
        # the words that all windows of a share have, and which share it is
        core = repeats.gram_hashes(w.hash, 16)
        first = at[row[hot]] - (share[hot] - 1) * SHARE
        key[hot] = mix(core[first] + share[hot].astype(np.uint64)).view(np.int64)
    name = row * 16 + share
    o = np.argsort(name, kind="stable")
    name, row, back, key = name[o], row[o], back[o], key[o]
    begin = np.flatnonzero(np.concatenate([[True], np.diff(name) != 0])) if len(name) else np.zeros(0, np.int64)
    none = np.zeros(0, np.int64)
    mask = np.bitwise_or.reduceat(1 << back, begin) if len(begin) else none
    most, least = (pick.reduceat(back, begin) if len(begin) else none for pick in (np.maximum, np.minimum))
    place = at[row[begin]]
    ctx = [w.text[x:y] for x, y in zip(w.place[place - most].tolist(), (w.place[place - least + WIDTH] - 1).tolist())]
    owner = np.searchsorted(w.ends, place, "right")
    k = int(new.sum())
    base = w.starts
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([pa.array(key[begin], t), pa.nulls(k, t)]),
        pa.array(np.concatenate([ids[owner], ids[d[new]]])),
        pa.array(np.concatenate([place - base[owner], m[new] - base[d[new]]])),
        pa.array(np.concatenate([mask, m[last] + WIDTH - m[new]]).astype(np.int32)),
        pa.concat_arrays([pa.array(ctx, pa.binary()), pa.nulls(k, pa.binary())]),
    ], names=["h", "doc_id", "p", "mask", "ctx"])


def _flat(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, words before the place) of each window of rows with these bits, most words first."""
    bits = (mask[:, None] >> np.arange(WIDTH - GRAM, -1, -1)) & 1
    row, k = np.nonzero(bits)
    return row, WIDTH - GRAM - k


def resolve(doc: np.ndarray, p: np.ndarray, mask: np.ndarray, ctx: list[bytes]):
    """(doc_id, s, e) of windows that an earlier row has; rows in order of doc_id and place. ``ctx``: the
    words from the first window's start to the last one's end."""
    row, back = _flat(mask)
    known: dict[bytes, int] = {}
    add = known.setdefault
    parts = [[add(x, len(known)) for x in c.split()] for c in ctx]
    ids = np.fromiter((x for s in parts for x in s), np.int32, sum(map(len, parts)))
    begin = np.concatenate([[0], np.cumsum([len(s) for s in parts])])
    top = np.zeros(len(mask), np.int64)
    np.maximum.at(top, row, back)
    lost = np.flatnonzero(_again(ids, begin[row] + top[row] - back, back))
    least, most = np.full(len(mask), WIDTH), np.full(len(mask), -1)
    np.minimum.at(least, row[lost], back[lost])
    np.maximum.at(most, row[lost], back[lost])
    # windows of one anchor all hold it, so what they cover is one range
    at = np.flatnonzero(most >= 0)
    return doc[at], p[at] - most[at], p[at] - least[at] + WIDTH


def marks(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = repeats.HOT) -> DataFrame:
    """doc_id, s, e: word ranges covered by windows that start earlier, but for whole copies."""
    lists = repeats.recurring(docs, _anchors, text, key, hot)
    gone = repeats.copies(docs, text, key)
    lists = lists.join(gone, "doc_id", "left_anti")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("t")).join(lists, "doc_id").select("doc_id", "t", "hs", "hot")
    found = table(map_chunks(rows, _windows, _OUT), "occurrences")
    going = found.where("h is not null")
    many = repeats.frequent(going, hot)
    few = going if many is None else going.join(many, "h", "left_anti")
    dealt = few.repartition("h").sortWithinPartitions("h", "doc_id", "p")

    def run(batches):
        held: list | None = None

        def solve(cols):
            # (a phrase that no other row has says nothing)
            same = cols[0][1:] == cols[0][:-1]
            use = np.flatnonzero(np.append(same, False) | np.concatenate([[False], same]))
            if not len(use):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["doc_id", "s", "e"])
            d, s, e = resolve(*(c[use] for c in cols[1:4]), [cols[4][k] for k in use.tolist()])
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], names=["doc_id", "s", "e"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy() for c in b.columns[:4]] + [b.column(4).to_pylist()]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held[:4], cols[:4])] + [held[4] + cols[4]]
            # the last phrase's group may go on in the next batch
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            held = [c[cut:] for c in cols]
            if cut:
                yield solve([c[:cut] for c in cols])
        if held is not None:
            yield solve(held)

    def single(batches):
        """Windows of rows that are too many for one task: their words, words before the place, doc_id, start."""
        for b in batches:
            out: list[list] = [[], [], [], []]
            for d, p, m, c in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                words, top = c.split(), m.bit_length() - 1
                for back in (k for k in range(top, -1, -1) if m >> k & 1):
                    for o, v in zip(out, (b" ".join(words[top - back : top - back + WIDTH]), back, d, p - back)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["w", "back", "doc_id", "s"])

    spread = None
    if many is not None:
        windows = map_arrow(going.join(many, "h", "left_semi"), single, "w binary, back long, doc_id long, s long")
        first = windows.groupBy("w", "back").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "s")).alias("f")).where("n > 1")
        spread = windows.join(first, ["w", "back"]).where((F.col("doc_id") != F.col("f.doc_id")) | (F.col("s") != F.col("f.s"))).select("doc_id", "s", (F.col("s") + WIDTH).alias("e"))
    settled = found.where("h is null").select("doc_id", F.col("p").alias("s"), (F.col("p") + F.col("mask")).alias("e"))
    out = settled.unionAll(map_arrow(dealt, run, "doc_id long, s long, e long"))
    return out if spread is None else out.unionAll(spread)


def removed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, marks (array of word ranges), copy (whether an earlier document has the same text)."""
    before = tables(docs.sparkSession)
    spans = table(repeats.spans_of(marks(docs, text, key)), "spans")
    drop_tables(docs.sparkSession, before)  # what marks has written on its way
    gone = repeats.copies(docs, text, key).withColumn("copy", F.lit(True))
    return spans.join(gone, "doc_id", "full_outer").select("doc_id", F.coalesce("marks", F.array()).alias("marks"), F.coalesce("copy", F.lit(False)).alias("copy"))


def kept_words(data: bytes, ranges, copy: bool) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = data.split()
    n = len(words)
    if copy:
        return ([] if n >= WIDTH else words), n
    if not ranges:
        return words, n
    s, e = repeats.merged(np.array([r["s"] for r in ranges]), np.array([r["e"] for r in ranges]), n)
    cuts = [0, *np.stack([s, e], 1).ravel().tolist(), n]
    return [x for a, b in zip(cuts[::2], cuts[1::2]) for x in words[a:b]], n


def _joined(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("t")).join(removed(docs, text, key), "doc_id", "left").select("doc_id", "t", "marks", "copy")


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256."""

    def run(cols):
        n, gone, sha = [], [], []
        for t, m, c in zip(*cols[1:]):
            words, k = kept_words(t or b"", m, bool(c))
            n.append(k)
            gone.append(k - len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_chunks(_joined(docs, text, key), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and text: the kept words joined by one space; null texts stay null."""

    def run(cols):
        out = [None if t is None else b" ".join(kept_words(t, m, bool(c))[0]).decode() for t, m, c in zip(*cols[1:])]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])

    return map_chunks(_joined(docs, text, key), run, "doc_id long, text string")
