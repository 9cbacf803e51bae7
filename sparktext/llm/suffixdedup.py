"""Operator 8: suffix-array deduplication with deep-shallow sorting.

Each byte that is covered by a ``width``-byte string that also starts earlier (smaller doc_id, or
earlier in the same document) is removed. The suffix array is sparse: it holds the suffixes that start
at anchors (see ``repeats``), of which every repeated string has one at the same place. Suffixes whose
anchor recurs are dealt by the anchor's hash, so all that could match are in one task, and each
task sorts its suffixes, and the reversed texts before them, by deep-shallow sorting: multikey
quicksort (eight bytes a key) to a shallow depth, then blind tries for the groups that are still
equal. The two orders with their longest common prefixes tell, for each offset of a window, which
suffixes agree on the whole window; the earliest keeps it.

Skew: copies of whole texts are settled by their hash before. A task that reads texts first drops
suffixes with the same surroundings as an earlier one of its chunk (they are marked at once), so a
passage in many documents comes once per chunk. The windows of an anchor met more than ``HOT`` times are
dealt in shares of ``SHARE`` neighbouring ones, each by the bytes all of them have. What is still more
than ``HOT`` rows of one name goes on as single windows by their 128-bit hash, whose first places a
partial aggregation finds; so no task ever holds more than ``HOT`` rows of one name.

Edge cases: null texts are empty and nothing is removed; rows with a null doc_id stay whole and
mark nothing; rows that share a doc_id are taken for one document (ranges are cut to each row's
length). Extra columns are ignored. Matches never cross documents.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from ._common import drop_tables, map_arrow, map_chunks, table, tables

WIDTH, GRAM = 100, 32
#: Windows of an often met anchor that are dealt together.
SHARE = 16
#: Bytes to which multikey quicksort goes.
SHALLOW = 48


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix of two strings of equal length."""
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def blind_trie(rows: list[bytes]) -> list[int]:
    """Sorted order of strings of equal length: a trie of branching places only. An insertion goes down
    without looking at the bytes between (blindly), compares once with the leaf it comes to, and
    goes to the place where that comparison failed."""
    # a node: [depth, branch bytes in order, children]; a leaf: a list of indices of equal strings
    size = len(rows[0])
    root = [size, None, [0]]
    for k in range(1, len(rows)):
        s, node = rows[k], root
        while node[1] is not None:
            at = bisect.bisect_left(node[1], s[node[0]])
            node = node[2][at if at < len(node[1]) and node[1][at] == s[node[0]] else 0]
        same = common(s, rows[node[2][0]])
        if same == size:
            node[2].append(k)
            continue
        other = rows[node[2][0]][same]
        node = root
        while node[1] is not None and node[0] < same:
            at = bisect.bisect_left(node[1], s[node[0]])
            node = node[2][at]
        leaf = [size, None, [k]]
        if node[1] is not None and node[0] == same:
            at = bisect.bisect_left(node[1], s[same])
            node[1].insert(at, s[same])
            node[2].insert(at, leaf)
        else:
            old = [*node]
            pair = sorted(((other, old), (s[same], leaf)), key=lambda x: x[0])
            node[:] = [same, [pair[0][0], pair[1][0]], [pair[0][1], pair[1][1]]]
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[1] is None:
            out += node[2]
        else:
            stack += node[2][::-1]
    return out


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of rows of bytes (n x width, uint8), and the common prefix of each with the one
    before it in that order (0 for the first)."""
    n, width = rows.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pad = np.zeros((n, -width % 8), np.uint8)
    keys = np.ascontiguousarray(np.concatenate([rows, pad], 1)).view(">u8").astype(np.uint64)
    order = np.argsort(keys[:, 0], kind="stable")
    tied = np.concatenate([[False], keys[order[1:], 0] == keys[order[:-1], 0]])
    depth = 1
    while depth < keys.shape[1] and depth * 8 < shallow:
        group = np.cumsum(~tied)
        open_ = tied | np.append(tied[1:], False)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        part = order[at]
        by = np.lexsort((keys[part, depth], group[at]))
        order[at] = part[by]
        tied[at[1:]] &= keys[order[at[1:]], depth] == keys[order[at[:-1]], depth]
        depth += 1
    starts = np.flatnonzero(tied & ~np.concatenate([[False], tied[:-1]])) - 1
    ends = np.flatnonzero(tied & ~np.append(tied[1:], False)) + 1
    if depth < keys.shape[1]:
        skip = depth * 8
        for a, b in zip(starts.tolist(), ends.tolist()):
            part = order[a:b]
            # tries hold texts of the group only; equal texts share a leaf
            deep = [rows[k, skip:].tobytes() for k in part.tolist()]
            order[a:b] = part[blind_trie(deep)]
    lcp = np.zeros(n, np.int64)
    for k in range(1, n, 65536):
        e = min(n, k + 65536)
        differ = rows[order[k:e]] != rows[order[k - 1 : e - 1]]
        lcp[k:e] = np.where(differ.any(1), differ.argmax(1), width)
    return order, lcp


def anchor_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM bytes at these places."""
    words = np.stack([np.ascontiguousarray(data[at[:, None] + np.arange(k, k + 8)]).view("<u8")[:, 0] for k in range(0, GRAM, 8)], 1) if len(at) else np.zeros((0, GRAM // 8), np.uint64)
    h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h = repeats.mix(h * np.uint64(0xD6E8FEB86659FD93) + words[:, k])
    return h


def _chunk(texts: list[bytes]):
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    return data, ends


def _anchors(texts: list[bytes]):
    data, ends = _chunk(texts)
    a = repeats.Anchors(data, ends, WIDTH, GRAM) if len(data) else None
    at = a.at if a else np.zeros(0, np.int64)
    return np.searchsorted(ends, at, "right"), anchor_hashes(data, at)


def _suffixes(cols):
    """Of a chunk: rows of (h, doc_id, p, lo, hi, around) for suffixes that go on, and marks
    (h null, doc_id, s, e as p, lo) settled in the chunk."""
    # earlier documents first, so what a chunk has seen is earlier
    order = sorted((k for k, t in enumerate(cols[1]) if t), key=lambda k: cols[0][k])
    out = {n: [] for n in ("h", "doc", "p", "lo", "hi", "ctx")}
    if order:
        texts = [cols[1][k] for k in order]
        ids = [cols[0][k] for k in order]
        data, ends = _chunk(texts)
        start = ends - np.array([len(t) for t in texts])
        a = repeats.Anchors(data, ends, WIDTH, GRAM)
        at = a.at
        doc = np.searchsorted(ends, at, "right")
        h = anchor_hashes(data, at).view(np.int64)
        keep, warm = np.zeros(len(at), bool), np.zeros(len(at), bool)
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        for k, src in enumerate(order):
            s = slice(cut[k], cut[k + 1])
            keep[s] = np.isin(h[s], np.array(cols[2][src], np.int64))
            if len(cols[3][src]):
                warm[s] = np.isin(h[s], np.array(cols[3][src], np.int64))
        at, doc, h, warm = at[keep], doc[keep], h[keep], warm[keep]
        lo, hi = a.windows(at)
        some = hi >= lo
        at, doc, h, warm, lo, hi = at[some], doc[some], h[some], warm[some], lo[some], hi[some]
        raw = data.tobytes()
        seen: set[bytes] = set()

        def put(key, d, p, lo, hi, ctx):
            for n, v in zip(("h", "doc", "p", "lo", "hi", "ctx"), (key, d, p, lo, hi, ctx)):
                out[n].append(v)

        for p, d, key, spread, x, y in zip(at.tolist(), doc.tolist(), h.tolist(), warm.tolist(), lo.tolist(), hi.tolist()):
            here, base = ids[d], int(start[d])
            if not spread:
                around = raw[p - y : p - x + WIDTH]
                name = around + bytes((x, y))
                if name in seen:
                    put(None, here, p - y - base, p - x + WIDTH - base, 0, None)
                else:
                    seen.add(name)
                    put(key, here, p - base, x, y, around)
                continue
            # an anchor met very often: its windows in shares, each by the bytes that all of a share have
            for low in range(x - x % SHARE, y + 1, SHARE):
                lo, hi = max(x, low), min(y, low + SHARE - 1)
                around = raw[p - hi : p - lo + WIDTH]
                name = around + bytes((lo, hi))
                if name in seen:
                    put(None, here, p - hi - base, p - lo + WIDTH - base, 0, None)
                else:
                    seen.add(name)
                    core = raw[p - low : p - low - SHARE + 1 + WIDTH]
                    put(xxhash.xxh64_intdigest(core, low) - (1 << 63), here, p - base, lo, hi, around)
    t = pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(out["h"], t), pa.array(out["doc"], t), pa.array(out["p"], t), pa.array(out["lo"], t), pa.array(out["hi"], t), pa.array(out["ctx"], pa.binary())], names=["h", "doc_id", "p", "lo", "hi", "ctx"])


def resolve(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, ctx: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which suffixes lose windows to an earlier row, and the range that these windows cover.

    Rows lie in the order of their place in the corpus. Row k has ``hi`` bytes before the anchor and
    ``width - lo`` from it on in ``ctx``; its windows start lo..hi bytes before the anchor.
    """
    n = len(p)
    right = np.zeros((n, WIDTH), np.uint8)
    left = np.zeros((n, WIDTH - GRAM), np.uint8)
    size = np.array([len(c) for c in ctx])
    flat = np.frombuffer(b"".join(ctx), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    row = np.repeat(np.arange(n), size)
    off = np.arange(len(flat)) - begin[row] - hi[row]
    fwd = off >= 0
    right[row[fwd], off[fwd]] = flat[fwd]
    left[row[~fwd], -1 - off[~fwd]] = flat[~fwd]
    order_r, lcp_r = deep_shallow(right)
    order_l, lcp_l = deep_shallow(left)
    least, most = np.full(n, WIDTH), np.full(n, -1)
    for back in range(int(lo.min()), int(hi.max()) + 1):
        ok = (lo <= back) & (back <= hi)
        r, m = np.empty(n, np.int64), np.empty(n, np.int64)
        r[order_r] = np.cumsum(lcp_r < WIDTH - back)
        m[order_l] = np.cumsum(lcp_l < back)
        at = np.flatnonzero(ok)
        if len(at) < 2:
            continue
        name = r[at] * (n + 1) + m[at]
        by = np.argsort(name, kind="stable")
        same = np.concatenate([[False], name[by][1:] == name[by][:-1]])
        lost = at[by[same]]  # all but the first of equal windows
        np.minimum.at(least, lost, back)
        np.maximum.at(most, lost, back)
    lost = np.flatnonzero(most >= 0)
    return lost, p[lost] - most[lost], p[lost] - least[lost] + WIDTH


def marks(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = repeats.HOT) -> DataFrame:
    """doc_id, s, e: byte ranges covered by strings that start earlier, but for whole copies."""
    lists = repeats.recurring(docs, _anchors, text, key, hot)
    gone = repeats.copies(docs, text, key)
    lists = lists.join(gone, "doc_id", "left_anti")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("t")).join(lists, "doc_id").select("doc_id", "t", "hs", "hot")
    found = table(map_chunks(rows, _suffixes, "h long, doc_id long, p long, lo long, hi long, ctx binary"), "suffixes")
    going = found.where("h is not null")
    many = repeats.frequent(going, hot)
    few = going if many is None else going.join(many, "h", "left_anti")
    dealt = few.repartition("h").sortWithinPartitions("h", "doc_id", "p")

    def single(batches):
        """Windows of suffixes that are too many for one task: w1, w2, doc_id, s."""
        for b in batches:
            out: list[list[int]] = [[], [], [], []]
            for d, p, x, y, c in zip(*(b.column(k).to_pylist() for k in range(5))):
                for back in range(x, y + 1):
                    w = xxhash.xxh128_intdigest(c[y - back : y - back + WIDTH])
                    for o, v in zip(out, ((w >> 64) - (1 << 63), (w & ((1 << 64) - 1)) - (1 << 63), d, p - back)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["w1", "w2", "doc_id", "s"])

    spread = None
    if many is not None:
        windows = map_arrow(going.join(many, "h", "left_semi").select("doc_id", "p", "lo", "hi", "ctx"), single, "w1 long, w2 long, doc_id long, s long")
        first = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "s")).alias("f")).where("n > 1")
        spread = windows.join(first, ["w1", "w2"]).where((F.col("doc_id") != F.col("f.doc_id")) | (F.col("s") != F.col("f.s"))).select("doc_id", "s", (F.col("s") + WIDTH).alias("e"))

    def run(batches):
        held: list | None = None

        def solve(cols):
            # (an anchor that no other row has says nothing)
            same = cols[0][1:] == cols[0][:-1]
            use = np.flatnonzero(np.append(same, False) | np.concatenate([[False], same]))
            if not len(use):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["doc_id", "s", "e"])
            cols = [c[use] for c in cols[:5]] + [[cols[5][k] for k in use.tolist()]]
            lost, s, e = resolve(cols[2], cols[3], cols[4], cols[5])
            return pa.RecordBatch.from_arrays([pa.array(cols[1][lost]), pa.array(s), pa.array(e)], names=["doc_id", "s", "e"])

        for b in batches:
            cols = [c.to_numpy() for c in b.columns[:5]] + [b.column(5).to_pylist()]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held[:5], cols[:5])] + [held[5] + cols[5]]
            # the last anchor's group may go on in the next batch
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            held = [c[cut:] for c in cols]
            if cut:
                yield solve([c[:cut] for c in cols])
        if held is not None:
            yield solve(held)

    more = map_arrow(dealt, run, "doc_id long, s long, e long")
    out = found.where("h is null").select("doc_id", F.col("p").alias("s"), F.col("lo").alias("e")).unionAll(more)
    return out if spread is None else out.unionAll(spread)


def removed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, marks (array of ranges), copy (whether an earlier document has the same text)."""
    before = tables(docs.sparkSession)
    spans = table(repeats.spans_of(marks(docs, text, key)), "spans")
    drop_tables(docs.sparkSession, before)  # what marks has written on its way
    gone = repeats.copies(docs, text, key).withColumn("copy", F.lit(True))
    return spans.join(gone, "doc_id", "full_outer").select("doc_id", F.coalesce("marks", F.array()).alias("marks"), F.coalesce("copy", F.lit(False)).alias("copy"))


def kept_parts(data: bytes, ranges, copy: bool, width: int = WIDTH) -> tuple[bytes, int, int]:
    """What stays of a text, removed bytes, removed runs."""
    n = len(data)
    if copy and n >= width:
        return b"", n, 1
    if not ranges or copy:
        return data, 0, 0
    s, e = repeats.merged(np.array([r["s"] for r in ranges]), np.array([r["e"] for r in ranges]), n)
    cuts = [0, *np.stack([s, e], 1).ravel().tolist(), n]
    kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
    return kept, n - len(kept), len(s)


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("t")).join(removed(docs, text, key), "doc_id", "left").select("doc_id", "t", "marks", "copy")

    def run(cols):
        out = [(len(t or b""), *kept_parts(t or b"", m, bool(c))) for t, m, c in zip(*cols[1:])]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64()), pa.array([hashlib.sha256(x[1]).hexdigest() for x in out])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_chunks(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", length: str = "n_chars") -> DataFrame:
    """The documents with repeated bytes taken out of their text; a character that loses a byte goes
    whole, so the text stays UTF-8. A column ``length``, if there, is set to the new number of
    characters of texts that change. Null texts stay null; no row goes."""
    found = removed(docs, text, key).select(F.col("doc_id").alias("_id"), F.col("marks").alias("_marks"), F.col("copy").alias("_copy"))
    joined = docs.join(found, docs[key] == found["_id"], "left").select(*(docs[c] for c in docs.columns), found["_marks"], found["_copy"])
    joined = joined.toDF(*(f"c{k}" for k in range(len(docs.columns) + 2)))  # whatever the documents' columns are called
    at = docs.columns.index(text)
    names = docs.columns
    size = names.index(length) if length in names else None

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                cols = b.slice(k, 512).columns
                ranges, copy = cols[-2].to_pylist(), cols[-1].to_pylist()
                if any(m or c for m, c in zip(ranges, copy)):
                    old = cols[at].to_pylist()
                    new = [t if t is None or not (m or c) else kept_parts(t.encode(), m, bool(c))[0].decode("utf-8", "ignore") for t, m, c in zip(old, ranges, copy)]
                    cols[at] = pa.array(new, cols[at].type)
                    if size is not None:
                        cols[size] = pa.array([n if s == t else len(t) for n, s, t in zip(cols[size].to_pylist(), old, new)], cols[size].type)
                yield pa.RecordBatch.from_arrays(cols[:-2], names=names)

    return map_arrow(joined, run, docs.schema)
