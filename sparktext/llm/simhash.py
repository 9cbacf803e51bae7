"""Operator 3: SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut in three segments (22, 21, 21 bits), each padded to a word of the
perfect (23, 12) Golay code. A segment's keys are the indices of all codewords within distance 4:
the nearest one and, at distance 3 from it, the five others that a decoder's table gives. Two words
at distance 2 or less have a word between them that is within distance 3 of some codeword, so that
codeword is within 4 of both: they share a key. By the pigeonhole principle, 4 differing bits over
three segments leave either one segment without a difference and another with at most 2, or three
segments with differences, of which two have just one and the third at most 2. In the first case the
whole segment and the other's index are a key (33 bits, 6 ordered pairs, up to 6 keys each); in the
second one half of each of the two segments is equal, and the two halves and the third's index are
a key (33 bits, 3 choices of the third, 4 of the halves, up to 6 keys each). Candidates are verified.

Fingerprints are first made distinct (copies collapse in a partial aggregation), so groups of exact
copies never meet. A key goes out with its node, cluster and 64 check bits (for sets, with size and folded parities), packed with the
others of its slot, so that the shuffle grows as the keys do; rows of one key lie together after one shuffle, and the
task that holds them compares all of that there, so pairs that meet by chance are never rows of a table. Links are found without emitting all pairs of a group:

1. the first part's keys are dealt and the clusters that their links give contracted, then those of the other keyed
   parts: a pair within one cluster is no link any more. A bucket gives its links between clusters if they
   are few (``FEW`` times its members at most), else one link for each member and, for round 2, its members
   under the digest of their set: buckets with the same members become one;
2. only buckets that still hold two clusters or more go on. A
   bucket's members are dealt in blocks of bounded size, and each pair of blocks is compared whole
   in one task, which gives a spanning forest of the links, not the links.

Skew: keys are counted in ``BINS`` bins; the rows of a bin with far more keys than most are dealt over
several tasks by the node, and a bucket of more than ``BLOCK`` rows is compared in blocks; both then go to
round 2 whole, where the blocks meet.

Connected components: large-star / small-star rounds over the written edge tables.

Edge cases: null and wordless texts have fingerprint zero and link like any other; fewer words than a
shingle are one shingle; repeated shingles count each time; repeated doc_ids are each reported;
rows with null doc_id keep their fingerprint and, alone, have a null component_id. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import CHUNK_BYTES, drop_tables, map_arrow, map_chunks, mix, table, tables

#: The fixed generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4
#: Fingerprints of a bucket that one task compares with as many others.
BLOCK = 4096
#: Links that a bucket gives for each of its members before only one link a member is given.
FEW = 2
#: Bins in which keys are counted to find those that need several tasks; rows of keys (of four columns) for each task.
BINS, TASK_ROWS = 1 << 16, 1 << 20
#: Slots of keys for each task, which holds the rows of one slot at a time.
SLOTS = 8
#: 64-bit words of the parities kept of a shingle set: hashes are counted in 64 * ODD cells.
ODD = 8
#: Words into which these are folded to go out with each key.
FOLD = 2


def fingerprint(data: bytes | None, size: int = 4, parts: int = 1) -> list[int]:
    """SimHash of a text's word shingles by XXH64 with seed 42; a bit is set if in over half the
    hashes. Further parts of 64 bits are made the same way from the mixed hashes."""
    return _bits(shingles(data, size), parts)


def shingles(data: bytes | None, size: int) -> np.ndarray:
    """Hashes of a text's word shingles, in order and with repeats."""
    words = data.lower().split() if data else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h64 = xxhash.xxh64_intdigest
    size = min(size, n)
    out = []
    for k in range(0, n - size + 1, 1 << 16):  # bounded memory for very long texts
        part = words[k : k + (1 << 16) + size - 1]
        out.append(np.array([h64(s, 42) for s in map(b" ".join, zip(*(part[i:] for i in range(size))))], np.uint64))
    return np.concatenate(out)


def _bits(hashes: np.ndarray, parts: int) -> list[int]:
    out = np.zeros((parts, 64), np.int64)
    for k in range(0, len(hashes), 1 << 16):
        h = hashes[k : k + (1 << 16)]
        for p in range(parts):
            out[p] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            h = mix(h + np.uint64(1))
    bits = (2 * out > len(hashes)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprints(docs: DataFrame, size: int = 4, parts: int = 1, text: str = "text", key: str = "doc_id", sets: bool = False) -> DataFrame:
    """doc_id, f0, f1, ... (the fingerprint's parts as signed 64-bit integers), size (of shingles; with
    ``sets`` distinct ones) and, with ``sets``, their set's digest and o0, o1, ... (its parities)."""
    names = [f"f{p}" for p in range(parts)]
    odds = [f"o{k}" for k in range(ODD)] if sets else []

    def run(cols):
        fp, sizes, digests, odd = [], [], [], []
        for t in cols[1]:
            h = shingles(t, size)
            fp.append(_bits(h, parts))
            h = np.unique(h) if sets else h
            sizes.append(len(h))
            digests.append(xxhash.xxh3_64_intdigest(h.tobytes()) if sets else 0)
            if sets:
                odd.append(parities(h))
        odd = np.array(odd, np.uint64).reshape(-1, ODD).view(np.int64)
        fp = np.array(fp, np.uint64).reshape(-1, parts).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(np.ascontiguousarray(fp[:, p])) for p in range(parts)), pa.array(sizes, pa.int64()), pa.array(np.array(digests, np.uint64).view(np.int64)), *(pa.array(np.ascontiguousarray(odd[:, k])) for k in range(len(odds)))], names=["doc_id", *names, "size", "digest", *odds])

    return map_chunks(docs.select(F.col(key).cast("long"), F.encode(text, "UTF-8")), run, ", ".join(f"{x} long" for x in ("doc_id", *names, "size", "digest", *odds)))


def parities(hashes: np.ndarray) -> np.ndarray:
    """Of each of 64 * ODD cells, whether an odd number of a set's hashes lies in it. Where two sets' parities
    differ, a hash lies in one set only, so sets differ in at least as many hashes as their parities in bits."""
    n = np.bincount((hashes % np.uint64(64 * ODD)).astype(np.int64), minlength=64 * ODD)
    return np.packbits((n & 1).astype(np.uint8), bitorder="little").view("<u8")


def _excess(share: float, apart, sizes):
    """By how much sets that differ in ``apart`` hashes at least, of these sizes together, differ too much for a
    similarity of ``share``: then they have at most (1 - share) / (1 + share) of the sizes' sum in one set only."""
    return apart - ((1 - share) / (1 + share) * sizes + 1e-6)


def _syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= ((v >> bit) & 1) * (GENERATOR << (bit - 11))
    return v


def decoder() -> np.ndarray:
    """Per syndrome, what to add to a word's upper 12 bits to get the indices of all codewords within
    distance 4; repeated where there are fewer than six."""
    err = [0] + [1 << a for a in range(23)]
    err += [1 << a | 1 << b for a in range(23) for b in range(a)]
    err += [1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b)]
    err = np.array(err, np.int64)
    leader = np.zeros(2048, np.int64)
    leader[_syndrome(err)] = err
    words = np.arange(4096, dtype=np.int64) << 11
    code = words | _syndrome(words)
    weight = np.bitwise_count(code)
    seven = code[weight == 7]
    out = np.repeat((leader >> 11)[:, None], 6, 1)
    for s in np.flatnonzero(np.bitwise_count(leader) == 3):
        near = seven[(seven & leader[s]) == leader[s]]
        out[s, 1:] = (leader[s] ^ near) >> 11
    return out


_DECODER = decoder()


def _segments(fp: np.ndarray):
    """Per segment: its bits, its six indices, and which of these are no repeats."""
    out = []
    for low, size in SEGMENTS:
        v = ((fp >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64)
        six = (v >> 11)[:, None] ^ _DECODER[_syndrome(v)]
        use = np.ones((len(fp), 6), bool)
        use[:, 1:] = six[:, :1] != six[:, 1:2]  # words near a codeword have one index
        out.append((v, six, use))
    return out


def wide_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) by the indices of two segments: words of two segments may differ in two bits each and
    mostly meet beyond that, so these keys find links at more bits than ``keys_of`` is sure of."""
    seg = _segments(fp)
    rows, keys = [], []
    for kind, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        use = seg[a][2][:, :, None] & seg[b][2][:, None, :]
        both = (seg[a][1][:, :, None] << 12) | seg[b][1][:, None, :] | (kind << 40)
        rows.append(np.nonzero(use)[0])
        keys.append(both[use])
    return np.concatenate(rows), np.concatenate(keys)


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints (unsigned); none is repeated."""
    seg = _segments(fp)
    whole, index, fresh = ([x[k] for x in seg] for k in range(3))
    halves = [(v & 0x7FF, v >> 11) for v in whole]
    keys, kind = [], 0
    for third in range(3):
        at = np.flatnonzero(fresh[third].ravel()) // 6
        six = index[third][fresh[third]]
        for one in range(3):
            if one != third:
                keys.append((at, (kind << 36) | (whole[one][at] << 12) | six))
                kind += 1
        a, b = (x for x in range(3) if x != third)
        for x in halves[a]:
            for y in halves[b]:
                keys.append((at, (kind << 36) | (x[at] << 23) | (y[at] << 12) | six))
                kind += 1
    return np.concatenate([r for r, _ in keys]), np.concatenate([k for _, k in keys])


def _keyed(batch: pa.RecordBatch, keyed: range, wide: bool):
    """(row, key) of the ``keyed`` parts (the columns from 2) of a batch of nodes."""
    for p in keyed:
        fp = batch.column(p - keyed.start + 2).to_numpy().view(np.uint64)
        row, key = wide_keys(fp) if wide else keys_of(fp)
        yield row, key | (p << 48)


def _bin(key: np.ndarray) -> np.ndarray:
    return (mix(key.view(np.uint64)) >> np.uint64(48)).astype(np.int64)


def _share(key: np.ndarray, node: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The share of its key that a node's row belongs to (0 but for keys of bins that are dealt over several)."""
    n = shares[_bin(key)]
    return np.where(n > 1, (mix(node.view(np.uint64)) % n.astype(np.uint64)).astype(np.int64), 0)


def _shares(nodes: DataFrame, keyed: range, wide: bool) -> tuple[np.ndarray, int]:
    """Tasks over which the keys of each bin are dealt (1 but for bins with far more keys than most), and
    the number of all keys. Bins are a fixed number, however many keys there are."""

    def run(batches):
        n = np.zeros(BINS, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                for _, key in _keyed(b.slice(k, BLOCK), keyed, wide):
                    n += np.bincount(_bin(key), minlength=BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bin", "n"])

    found = map_arrow(nodes, run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(BINS, np.int64)
    n[found.column("bin").to_numpy()] = found.column("n").to_numpy()
    total = int(n.sum())
    most = 4 * total // BINS + BLOCK
    return np.maximum(1, -(-n // most)), total


def _pack(*cols: np.ndarray) -> bytes:
    """Columns of 64-bit values, byte by byte: equal high bytes lie together, so that little is left of them
    once compressed, however few rows there are."""
    return np.stack(cols).view(np.uint8).reshape(len(cols), -1, 8).transpose(0, 2, 1).tobytes()


def _unpack(data: bytes, columns: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(columns, 8, -1).transpose(0, 2, 1)).view(np.int64)[:, :, 0]


def _buckets(nodes: DataFrame, keyed: range, wide: bool, check: str, sets: bool) -> tuple[DataFrame, np.ndarray]:
    """(slot, rows) for the keys of each node's ``keyed`` parts, dealt and sorted by slot, and the number of
    shares by bin. A slot takes whole buckets (keys, or shares of one); its rows (key, node, cluster, check bits and,
    with ``sets``, size and folded parities) of one block of nodes are packed together, so that a key costs its bytes
    and no row of its own."""
    odds = [reduce(Column.bitwiseXOR, (F.col(f"o{k}") for k in range(e, ODD, FOLD))).alias(f"e{e}") for e in range(FOLD)]
    checks = [F.col(check).alias("bits"), *(["size", *odds] if sets else [])]
    # nodes are small and their keys many: tasks by the number of nodes, so that none makes millions of keys at once
    nodes = nodes.repartition(nodes.count() // (2 * BLOCK) + 1, "node").select("node", "cluster", *(f"f{p}" for p in keyed), *checks)
    shares, total = _shares(nodes, keyed, wide)
    tasks = total * (3 + len(checks)) // (4 * TASK_ROWS) + 1
    slots = tasks * SLOTS

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                part = b.slice(k, BLOCK)
                node, cluster, *rest = (c.to_numpy() for c in part.columns)
                row, key = (np.concatenate(x) for x in zip(*_keyed(part, keyed, wide)))
                share = _share(key, node[row], shares)
                h = mix(key.view(np.uint64) + share.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                slot = (h & np.uint64(0xFFFFFFFF)) * np.uint64(slots) >> np.uint64(32)
                by = np.argsort(slot.astype(np.uint16 if slots <= 1 << 16 else np.uint32), kind="stable")
                slot, key, row = slot[by].astype(np.int64), key[by], row[by]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(slot)) + 1, [len(slot)]])
                own = (node, node ^ cluster, *rest[len(keyed) :])  # most are their own cluster, and zero takes no room
                at, rows, held = [], [], 0
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    at.append(slot[x] if y > x else 0)
                    rows.append(_pack(key[x:y], *(c[row[x:y]] for c in own)))
                    held += len(rows[-1])
                    if held >= CHUNK_BYTES:  # small batches, as the executor holds them besides its heap
                        yield batch(at, rows)
                        at, rows, held = [], [], 0
                if held:
                    yield batch(at, rows)

    def batch(at, rows):
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(rows, pa.binary())], names=["slot", "rows"])

    # slots have about equal numbers of rows, so each task takes SLOTS of them by number, not as a hash deals them
    dealt = map_arrow(nodes, run, "slot long, rows binary").repartitionById(tasks, F.expr(f"CAST(slot DIV {SLOTS} AS INT)"))
    return dealt.sortWithinPartitions("slot"), shares


def _runs(key: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Where the rows of each bucket start."""
    return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (share[1:] != share[:-1])]))


def _links(bits: np.ndarray, cluster: np.ndarray, begin: np.ndarray, size: np.ndarray, limit: int, block: int = BLOCK, sets: list[np.ndarray] | None = None, share: float = 0.0):
    """(a, b, run, many): rows a before b of one run and of two clusters at ``limit`` or fewer differing bits, whose
    ``sets`` (sizes, folded parities) allow a similarity of ``share``, and how many such pairs each run has. Runs
    with more than FEW pairs a row give one for each b. Runs of more than ``block`` are compared in blocks."""

    def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of pairs that are near by bits."""
        ok = cluster[x] != cluster[y]
        if share:
            one, two = (sets[0][k].astype(np.int64) for k in (x, y))
            ok &= np.minimum(one, two) >= share * np.maximum(one, two)
            ok &= _excess(share, sum(np.bitwise_count(p[x] ^ p[y]).astype(np.int16) for p in sets[1:]), one + two) <= 0
        return ok

    run = np.repeat(np.arange(len(begin)), size)
    small = min(32, block)
    left = np.where(size[run] <= small, (begin + size)[run] - np.arange(len(run)) - 1, 0)
    a, b = [], []
    at = np.flatnonzero(left)
    d = 1
    while len(at):
        ok = at[np.bitwise_count(bits[at] ^ bits[at + d]) <= limit]
        ok = ok[linked(ok, ok + d)]
        a.append(ok)
        b.append(ok + d)
        d += 1
        at = at[left[at] >= d]
    many = np.bincount(run[np.concatenate(a)], minlength=len(begin)) if a else np.zeros(len(begin), np.int64)
    for k in np.flatnonzero(size > small).tolist():
        if (cluster[begin[k] : begin[k] + size[k]] == cluster[begin[k]]).all():
            continue
        for s in range(begin[k], begin[k] + size[k], block):
            x = bits[s : min(s + block, begin[k] + size[k])]
            every, first = [], []
            for low in range(0, len(x), 256):
                i, j = np.nonzero(np.triu(np.bitwise_count(x[None, :] ^ x[low : low + 256, None]) <= limit, low + 1))
                ok = linked(s + low + i, s + j)
                i, j = i[ok], j[ok]
                many[k] += len(i)
                one = np.unique(j, return_index=True)[1]
                first.append((i[one] + low, j[one]))
                if many[k] <= FEW * size[k]:
                    every.append((i + low, j))
            for i, j in every if many[k] <= FEW * size[k] else first:
                a.append(s + i)
                b.append(s + j)
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    dense = many[run[b]] > FEW * size[run[b]]
    by = np.lexsort((a, b))
    keep = ~dense
    keep[by[np.diff(b[by], prepend=-1) != 0]] = True
    return a[keep], b[keep], run, many


def _meet(rows: DataFrame, shares: np.ndarray, limit: int, block: int = BLOCK, share: float = 0.0) -> DataFrame:
    """Of dealt buckets: links between clusters (name null, a, b: nodes) by what goes with a key, and members
    (name, a, b null) of the buckets that need another look."""

    def solve(held: list[bytes]) -> pa.RecordBatch:
        key, node, away, *checks = np.concatenate([_unpack(x, 4 + (1 + FOLD if share else 0)) for x in held], axis=1)
        dealt = _share(key, node, shares)
        by = np.lexsort((node, dealt, key) if dealt.any() else (node, key))
        key, dealt, node, cluster = key[by], dealt[by], node[by], (node ^ away)[by]
        bits, *sets = (c[by].view(np.uint64) for c in checks)
        begin = _runs(key, dealt)
        size = np.diff(np.append(begin, len(key)))
        a, b, run, many = _links(bits, cluster, begin, size, limit, block, sets, share)
        names, members = [], []
        split = (shares[_bin(key[begin])] > 1) | (size > block)
        for k in np.flatnonzero(split | (many > FEW * size)).tolist():
            own = node[begin[k] : begin[k] + size[k]]
            members.append(own)
            # a set's name is its digest; that of a split bucket its key (a name met twice joins two buckets, which loses nothing)
            names.append(np.full(len(own), key[begin[k]] if split[k] else xxhash.xxh3_64_intdigest(np.sort(own).tobytes()) - (1 << 63)))
        members = np.concatenate(members) if members else np.zeros(0, np.int64)
        names = np.concatenate(names) if names else np.zeros(0, np.int64)
        x, y = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(names, pa.int64())]),
            pa.array(np.concatenate([x, members])),
            pa.concat_arrays([pa.array(y), pa.nulls(len(members), pa.int64())]),
        ], names=["name", "a", "b"])

    def run(batches):
        # one slot at a time: its rows may come in several batches
        now, held = None, []
        for batch in batches:
            for slot, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if slot != now and held:
                    yield solve(held)
                    held = []
                now = slot
                held.append(rows)
        if held:
            yield solve(held)

    return map_arrow(rows, run, "name long, a long, b long")


def _forest(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, na: np.ndarray, nb: np.ndarray, limit: int, every: bool = False, sizes: tuple | None = None, odd: tuple | None = None, share: float = 0.0):
    """Edges between clusters that link the fingerprints a (rows of parts; clusters ca, nodes na) with
    b, each with its two nodes: a spanning forest or, with ``every``, all links between clusters. Sets whose
    sizes or parities rule out a similarity of ``share`` are left out. Yields arrays of bounded size."""
    names, both = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    if len(names) < 2:
        return
    ia, ib = both[: len(ca)], both[len(ca) :]
    up = list(range(len(names)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k in range(0, len(a), 256):
        away = sum(np.bitwise_count(a[k : k + 256, None, p] ^ b[None, :, p]).astype(np.int16) for p in range(a.shape[1]))
        near = (away <= limit) & (ia[k : k + 256, None] != ib[None, :])
        if share:
            one, two = sizes[0][k : k + 256, None], sizes[1][None, :]
            near &= np.minimum(one, two) >= share * np.maximum(one, two)
        x, y = np.nonzero(near)
        if share and len(x):
            apart = sum(np.bitwise_count(odd[0][k + x, p] ^ odd[1][y, p]).astype(np.int16) for p in range(ODD))
            ok = _excess(share, apart, sizes[0][k + x] + sizes[1][y]) <= 0
            x, y = x[ok], y[ok]
        if every:
            yield np.stack([ca[k + x], cb[y], na[k + x], nb[y]], 1)
            continue
        for p, i in zip(*(v.tolist() for v in np.unique(ia[k + x] * len(names) + ib[y], return_index=True))):
            r, s = root(p // len(names)), root(p % len(names))
            if r != s:
                up[max(r, s)] = min(r, s)
                out.append((int(names[p // len(names)]), int(names[p % len(names)]), int(na[k + x[i]]), int(nb[y[i]])))
    if out:
        yield np.array(out, np.int64)


def _cross(buckets: DataFrame, parts: int, limit: int, block: int = BLOCK, nodes: bool = False, every: bool = False, share: float = 0.0) -> DataFrame:
    """Edges (a, b) between clusters, with ``nodes`` by their nodes (x, y), from buckets (key, node, cluster, f0..) that hold two clusters or more.

    Members are dealt in blocks by a hash of the node; a bucket of n members has ceil(n / block)
    blocks, and each pair of blocks is one group of at most about twice ``block`` rows.
    """
    spread = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo <> hi").select("key", F.ceil(F.col("n") / block).cast("int").alias("m"))
    rows = buckets.join(spread, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    fs = [f"f{p}" for p in range(parts)] + ([f"o{k}" for k in range(ODD)] if share else [])
    ids = ["node"] if nodes else []
    dealt = rows.select("key", "own", "cluster", *ids, *fs, "size", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cluster", *ids, *fs, "size")
    # groups are small and many: a task takes its share of groups as one sorted run
    dealt = dealt.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")

    def solve(cols):
        key, i, j, own, cl = cols[:5]
        node = cols[5] if nodes else cl
        fp, size = np.stack(cols[5 + nodes : -1], 1).view(np.uint64), cols[-1]
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        for s, e in zip([0, *cut], [*cut, len(key)]):
            x, w, c, n, o, z = fp[s:e, :parts], fp[s:e, parts:], cl[s:e], node[s:e], own[s:e], size[s:e]
            if i[s] == j[s]:
                yield from _forest(x, x, c, c, n, n, limit, every, (z, z), (w, w), share)
            else:
                p, q = o == i[s], o == j[s]
                yield from _forest(x[p], x[q], c[p], c[q], n[p], n[q], limit, every, (z[p], z[q]), (w[p], w[q]), share)

    def batches_of(found):
        held, size = [], 0
        for a in found:
            held.append(a)
            size += len(a)
            if size >= 1 << 16:
                yield batch(np.concatenate(held))
                held, size = [], 0
        if held:
            yield batch(np.concatenate(held))

    def batch(a):
        a = np.unique(np.where((a[:, 2] > a[:, 3])[:, None], a[:, [1, 0, 3, 2]], a), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(a[:, k]) for k in range(4 if nodes else 2)], names=names)

    names = ["a", "b", "x", "y"] if nodes else ["a", "b"]

    def run(batches):
        held = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(cols[0]):
                continue
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            # the last group may go on in the next batch
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            start = int(np.argmax(last))
            held = [c[start:] for c in cols]
            if start:
                yield from batches_of(solve([c[:start] for c in cols]))
        if held is not None:
            yield from batches_of(solve(held))

    return map_arrow(dealt, run, ", ".join(f"{x} long" for x in names)).distinct()


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """Connected components of edges (a, b): node, root (the smallest node), by alternating large and
    small stars; each round is a written table, and rounds end when nothing changes."""
    now = table(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "edges")
    before = None

    def lowest(edges: DataFrame) -> DataFrame:
        # joined by another name of ``a``: the small side is shuffled anew, so that Spark may split a hub's edges over tasks
        low = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.bitwise_not("a").alias("k"), "m")
        return edges.withColumn("k", F.bitwise_not("a")).join(low, "k")

    for _ in range(most):
        # large star: all larger neighbours of a node go to its smallest neighbour
        both = now.unionByName(now.select(F.col("a").alias("b"), F.col("b").alias("a")))
        large = lowest(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        # small star: all smaller neighbours of a node, and itself, go to its smallest neighbour
        small = lowest(large).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = table(small, "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def clusters(nodes: DataFrame, parts: int = 1, keyed: int = 1, limit: int = MAX_BITS, wide: bool = False, block: int = BLOCK, near: int | None = None, confirm: Callable[[DataFrame], DataFrame] | None = None, share: float = 0.0) -> DataFrame:
    """node, cluster (the smallest node reachable by links) for a table of nodes with distinct
    fingerprints (f0, ...). Nodes link at ``limit`` or fewer differing bits over all parts; they meet by
    the keys (``wide`` ones, or sure ones) of the first ``keyed`` parts, of the first and then of the others. One key in common brings a pair to
    the check, first of the last part's bits alone (``near`` or fewer may differ), then of all.
    ``share``: similarity of sets (columns ``size``, ``o0``, ...) that a link's sizes and parities must allow."""
    fs = [f"f{p}" for p in range(parts)]
    odds = [f"o{k}" for k in range(ODD if share else 0)]
    of = [*fs, "size", *odds]
    spark = nodes.sparkSession
    before = tables(spark)
    if "size" not in nodes.columns:
        nodes = nodes.withColumn("size", F.lit(1).cast("long"))
    label, again = nodes.select("node", F.col("node").alias("cluster"), *of), None
    for some in (range(1), range(1, keyed)) if keyed > 1 else (range(1),):
        met = table(_meet(*_buckets(label, some, wide, fs[-1], share > 0), limit if near is None else near, block, share), "met")
        links = met.where("name is null").select("a", "b").distinct()
        low = label.select(F.col("node").alias("a"), F.col("cluster").alias("ca"), *(F.col(c).alias(f"l{c}") for c in of))

        def differ(names: list[str]):
            return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"l{c}"))) for c in names), F.lit(0))

        if parts > 1:
            may = differ(fs) <= limit
            if share:
                may &= _excess(share, differ(odds), F.col("size") + F.col("lsize")) <= 0
            links = links.join(low, "a").join(label.select(F.col("node").alias("b"), F.col("cluster").alias("cb"), *of), "b").where(may)
            links = links.select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("a").alias("x"), F.col("b").alias("y"))
        else:
            links = links.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"))
        linked = components(links if confirm is None else confirm(links)).withColumnRenamed("node", "a")
        held = met.where("name is not null").select(F.col("name").alias("key"), F.col("a").alias("node")).distinct()
        again = table(held if again is None else again.unionByName(held), "again")
        label = table(label.join(linked, label["cluster"] == linked["a"], "left").select("node", F.coalesce("root", "cluster").alias("cluster"), *of), "clusters")
        drop_tables(spark, before, 2)  # all but the buckets and the labels
    if again.isEmpty():
        return label.select("node", "cluster")
    # a forest by bits joins most of what belongs together; a link that isn't confirmed may hide another
    # between the same clusters, so all links between the clusters that are left are tried after it
    for every in (False,) if confirm is None else (False, True):
        edges = _cross(again.join(label, "node"), parts, limit, block, confirm is not None, every, share)
        more = components(edges if confirm is None else confirm(edges)).withColumnRenamed("node", "a")
        label = table(label.join(more, label["cluster"] == more["a"], "left").select("node", F.coalesce("root", "cluster").alias("cluster"), *of), "clusters")
        drop_tables(spark, before + 1)
    drop_tables(spark, before)
    return label.select("node", "cluster")


def confirmed(docs: DataFrame, similarity: float, size: int, text: str = "text", key: str = "doc_id") -> Callable[[DataFrame], DataFrame]:
    """A function that keeps the links (a, b) whose documents (x, y) have the given Jaccard similarity
    of shingle sets or more; sets hold 64-bit hashes. Texts without words are alike."""

    def sets(cols):
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([np.unique(shingles(t, size)).tobytes() for t in cols[1]], pa.binary())], names=["node", "set"])

    def alike(batches):
        for b in batches:
            keep = []
            for one, two in zip(b.column("p").to_pylist(), b.column("q").to_pylist()):
                one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                low, high = sorted((len(one), len(two)))
                same = len(np.intersect1d(one, two, assume_unique=True)) if low >= similarity * high else 0
                keep.append(not high or same >= similarity * (low + high - same))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def confirm(links: DataFrame) -> DataFrame:
        links = table(links, "links")
        ids = links.select(F.col("x").alias("_id")).unionAll(links.select("y")).distinct()
        rows = docs.select(F.col(key).cast("long").alias("node"), F.encode(text, "UTF-8").alias("t"))
        held = table(map_chunks(rows.join(ids, rows["node"] == ids["_id"], "left_semi"), sets, "node long, set binary"), "sets")
        both = links.join(held.select(F.col("node").alias("y"), F.col("set").alias("q")), "y").join(held.select(F.col("node").alias("x"), F.col("set").alias("p")), "x")
        return table(map_arrow(both.select("a", "b", "p", "q"), alike, "a long, b long").distinct(), "confirmed")

    return confirm


def near_duplicates(docs: DataFrame, size: int = 4, parts: int = 1, keyed: int = 1, limit: int = MAX_BITS, wide: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: fingerprint (hex of all parts), component_id (smallest doc_id reachable)."""
    fs = [f"f{p}" for p in range(parts)]
    marked = table(fingerprints(docs, size, parts, text, key, wide), "fingerprints")
    nodes = table(marked.groupBy(*fs).agg(F.min("doc_id").alias("node")).where("node is not null"), "nodes")
    found = nodes.join(clusters(nodes, parts, keyed, limit, wide), "node").select(*fs, F.col("cluster").alias("component_id"))
    return marked.join(found, fs, "left").select("doc_id", F.concat(*(F.lower(F.lpad(F.hex(f), 16, "0")) for f in fs)).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def bits_at(similarity: float, parts: int) -> int:
    """Differing bits to expect at a Jaccard similarity of shingle sets: the angle between the sets'
    vectors, whose cosine is 2s / (1 + s), as a share of all bits; three standard deviations
    are added so that pairs at the limit itself are found."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    n = 64 * parts
    return int(n * share + 3 * np.sqrt(n * share * (1 - share)))


def deduplicate(docs: DataFrame, similarity: float = 0.8, size: int = 5, parts: int = 4, keyed: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id.

    Copies at a similarity of 0.8 differ in about 15 % of the bits, more than the four of 64 that one
    fingerprint's keys are sure to meet. So documents get ``parts`` fingerprints of independent bits
    (compared together) and meet by the wide keys of ``keyed`` of them. Bits only select candidates: a
    link needs the similarity of the two texts' shingle sets themselves. Rows without a doc_id stay.
    """
    names = [*(f"f{p}" for p in range(parts)), "size", "digest"]
    marked = table(fingerprints(docs, size, parts, text, key, True), "fingerprints")
    # rows of one digest have one set, so its parities as well
    nodes = table(marked.groupBy(*names).agg(F.min("doc_id").alias("node"), *(F.min(f"o{k}").alias(f"o{k}") for k in range(ODD))).where("node is not null"), "nodes")
    found = clusters(nodes, parts, keyed, bits_at(similarity, parts), True, near=bits_at(similarity, 1), confirm=confirmed(docs, similarity, size, text, key), share=similarity)
    groups = marked.join(nodes.join(found, "node"), names).where("doc_id <> cluster")
    out = groups.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(out, docs[key] == out["_gone"], "left_anti")
