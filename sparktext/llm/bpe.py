"""Operator 6: byte-level BPE by a lazily determinised finite-state transducer.

The merges (ranks) of a tokenizer are compiled into a transducer that reads a piece byte by byte
and emits tokens as soon as no continuation can change them. Its states are made when first met:
a state is the last settled token and the bytes read since, which fix everything that follows.

Why it is exact: a token sequence is the result of the merges if and only if each pair of
neighbours is (merging the two tokens' bytes gives the two tokens back). So the last token of the
prefix ``p[:j]`` is the one suffix token that is compatible with the last token before it, and all
prefixes form a tree. A later token starts at a position from which the bytes read so far are a
proper prefix of some token; a boundary on the tree paths of all such positions is settled. The
lookahead is thus bounded by the longest token's chain of prefixes, not by the text.

The state table is bounded. Once it is full, a transition that is not in it is followed by
simulating the same machine without making states, which costs less than making states that are met
once.

Decoding streams the ids' bytes through an incremental UTF-8 machine that holds back the bytes of
an unfinished character between chunks.

Edge cases: null text is the empty text (no ids); an empty text gives no ids; ids outside the
vocabulary raise ``KeyError`` in decoding; bytes that are not UTF-8 decode to U+FFFD, while the
decoded bytes stay as they are. Extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import at_task_end, map_arrow, map_chunks

#: States that a worker makes, and pieces of each of the two generations it keeps.
MAX_STATES = 20_000
MAX_PIECES = 200_000


def load_ranks(lines) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file, given as its lines (bytes)."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class MergeTransducer:
    """Merges compiled to a transducer over bytes, determinised as it is used."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.packed = {v: struct.pack("<I", v) for v in ranks.values()}
        # of each token and each proper prefix of one: 2 * id (or -2), plus 1 if it is a proper prefix
        self.trie = {t: 2 * v for t, v in ranks.items()}
        for t in ranks:
            for k in range(1, len(t)):
                self.trie[t[:k]] = self.trie.get(t[:k], -2) | 1
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._valid: dict[int, bool] = {}
        self.states: dict[tuple, tuple] = {}
        self.start = self._state((-1, b""), [-1], [0], [0])

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte or if merges don't make it."""
        if token not in self._parts:
            data = self.bytes_of[token]
            pieces = [data[k : k + 1] for k in range(len(data))]
            while len(pieces) > 2:
                best = min((self.ranks.get(pieces[k] + pieces[k + 1], 1 << 60), k) for k in range(len(pieces) - 1))
                if best[0] == 1 << 60:
                    break
                pieces[best[1] : best[1] + 2] = [pieces[best[1]] + pieces[best[1] + 1]]
            self._parts[token] = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None
        return self._parts[token]

    def valid(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens gives just these two tokens.

        It fails if some merge crosses the boundary before both tokens are whole. The tokens beside
        the boundary over time are the last parts of ``left`` and the first parts of ``right``; going
        back in time, the later of the two merges is undone first, and a crossing merge comes into
        play if its rank is below those of the merges undone so far. Of equal ranks the left one
        goes first.
        """
        key = left << 32 | right
        v = self._valid.get(key)
        if v is None:
            if len(self._valid) > 300_000:
                self._valid.clear()
            if left < 0:
                v = len(self.bytes_of[right]) == 1 or self.parts(right) is not None
            else:
                v = self._stands(left, right)
            self._valid[key] = v
        return v

    def _stands(self, left: int, right: int) -> bool:
        bytes_of, ranks = self.bytes_of, self.ranks
        a, b, bound = left, right, 1 << 60  # a crossing merge of rank below bound comes before
        while True:
            cross = ranks.get(bytes_of[a] + bytes_of[b])
            if cross is not None and cross < bound:
                return False
            pa_, pb = self.parts(a), self.parts(b)
            if pa_ is None and pb is None:
                return True
            if pb is None or (pa_ is not None and a > b):
                # at equal rank the crossing pair would lie to the right of a's own merge
                a, bound = pa_[1], a
            else:
                # and to the left of b's own merge
                b, bound = pb[0], b + 1

    def _state(self, key: tuple, last: list, back: list, live: list) -> tuple:
        """A state: next states by byte, what it emits if the piece ends there, its key; for each
        prefix of the pending bytes the last token (None: of no use) and where that starts; and the
        positions from which a later token can start."""
        out, j = [], len(key[1])
        while j:
            out.append(self.packed[last[j]])
            j = back[j]
        out.reverse()
        state = self.states[key] = ({}, b"".join(out), key, last, back, live)
        return state

    def _read(self, data: bytes, n: int, last: list, back: list, live: list) -> list:
        """Read the byte ``data[n - 1]``: fills in the last token of the first n bytes and where it
        starts; returns the positions that are live after it."""
        trie, after, found = self.trie, [], False
        for j in live:
            x = trie.get(data[j:n])
            if x is None:
                continue
            if x & 1:
                after.append(j)
            if not found and x >= 0 and self.valid(last[j], x >> 1):
                found = True
                last.append(x >> 1)
                back.append(j)
        if not found:
            raise ValueError("the vocabulary lacks a byte or isn't made by merges")
        after.append(n)
        return after

    def step(self, state: tuple, byte: int) -> tuple[tuple, bytes]:
        """The next state and what is emitted on the way; made once for each pair met."""
        data = state[2][1] + bytes((byte,))
        n = len(data)
        last, back = [*state[3]], [*state[4]]
        live = self._read(data, n, last, back, state[5])
        # the nearest boundary that all live paths share
        front = [*live]
        while len(front) > 1:
            k = back[front.pop()]
            if k not in front:
                front.append(k)
                front.sort()
        common = front[0]
        emitted, k = [], common
        while k:
            emitted.append(self.packed[last[k]])
            k = back[k]
        emitted.reverse()
        key = (last[common], data[common:])
        nxt = self.states.get(key)
        if nxt is None:
            kept, on = [None] * (n + 1 - common), [0] * (n + 1 - common)
            for k in live:
                while kept[k - common] is None:
                    kept[k - common] = last[k]
                    if k == common:
                        break
                    on[k - common] = back[k] - common
                    k = back[k]
            nxt = self._state(key, kept, on, [k - common for k in live])
        done = (nxt, b"".join(emitted))
        state[0][byte] = done
        return done

    def simulate(self, state: tuple, rest: bytes) -> bytes:
        """What the machine emits from ``state`` to the end of the piece, without making states."""
        pending = state[2][1]
        data = pending + rest
        last, back, live = [*state[3]], [*state[4]], state[5]
        for n in range(len(pending) + 1, len(data) + 1):
            live = self._read(data, n, last, back, live)
        out, k = [], len(data)
        while k:
            out.append(self.packed[last[k]])
            k = back[k]
        out.reverse()
        return b"".join(out)

    def encode(self, piece: bytes) -> bytes:
        """The ids of one piece as little-endian 32-bit integers. A piece that is a token is that token."""
        t = self.ranks.get(piece)
        if t is not None:
            return self.packed[t]
        state, out = self.start, []
        for k, byte in enumerate(piece):
            hit = state[0].get(byte)
            if hit is None:
                if len(self.states) >= self.max_states:
                    out.append(self.simulate(state, piece[k:]))
                    return b"".join(out)
                hit = self.step(state, byte)
            state, emitted = hit
            if emitted:
                out.append(emitted)
        out.append(state[1])
        return b"".join(out)


class Pieces(dict):
    """Encoded pieces, in two generations of bounded size: the older one goes when the newer is full."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece.encode())
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class ByteBPE:
    """Text to ids and back, with the transducer's results kept by piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES):
        import regex

        self.fst = MergeTransducer(ranks)
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(self.fst.encode, max_pieces)
        self.vocab = self.fst.bytes_of

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian 32-bit integers one after the other."""
        known = self.pieces
        return b"".join([known[p] for p in self.split(text)])

    def decode(self, ids: np.ndarray, step: int = 1 << 16):
        """Chunks of decoded bytes; each ends at the end of a character."""
        machine, vocab = Utf8Machine(), self.vocab
        for k in range(0, len(ids), step):
            yield machine.push(b"".join([vocab[t] for t in ids[k : k + step].tolist()]))
        if rest := machine.finish():
            yield rest


class Utf8Machine:
    """Incremental UTF-8: takes bytes in any cuts, gives back whole characters.

    The state is what the unfinished character still needs: (continuation bytes, range of the
    next one). A byte that doesn't fit ends the broken character; its bytes are passed on as they
    are, so nothing is lost. Characters are found from the last start byte on, so a push costs a
    few steps whatever its length.
    """

    #: Fixed values of UTF-8: start bytes (first, last), bytes that follow, range of the second byte.
    STARTS = ((0x00, 0x7F, 0, 0x80, 0xBF), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))

    def __init__(self):
        self.held = b""

    @classmethod
    def unfinished(cls, tail: bytes) -> bool:
        """Whether ``tail``, from a start byte on, is a proper prefix of a character."""
        for first, last, more, low, high in cls.STARTS:
            if first <= tail[0] <= last:
                rest = tail[1:]
                return len(rest) < more and all((low if k == 0 else 0x80) <= c <= (high if k == 0 else 0xBF) for k, c in enumerate(rest))
        return False

    def push(self, data: bytes) -> bytes:
        data = self.held + data
        for back in range(1, min(3, len(data)) + 1):
            c = data[-back]
            if c & 0xC0 != 0x80:  # a start byte or ASCII
                if c >= 0xC0 and self.unfinished(data[-back:]):
                    self.held = data[-back:]
                    return data[:-back]
                break
        self.held = b""
        return data

    def finish(self) -> bytes:
        rest, self.held = self.held, b""
        return rest


@functools.lru_cache(maxsize=2)
def _coder(name: str, data: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(load_ranks(data.splitlines()), pattern)


at_task_end(_coder.cache_clear)


class Vocabulary:
    """What executors need of a tokenizer: its file's bytes (a fixed file of about 1 MB) and pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.data = f.read()
        self.pattern = pattern
        self.name = hashlib.sha256(self.data).hexdigest()

    def coder(self) -> ByteBPE:
        return _coder(self.name, self.data, self.pattern)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids array<int>``, ``n_tokens long`` of each row's whole text."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(cols):
        coder = spec.value.coder()
        ids = [np.frombuffer(coder.encode((t or b"").decode()), "<u4") for t in cols[1]]
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends), pa.int64())], names=[key, "ids", "n_tokens"])

    return map_chunks(docs.select(F.col(key).cast("long"), F.encode(text, "UTF-8")), run, f"{key} long, ids array<int>, n_tokens long")


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key``, ``text string`` of each row's ids; a null list is the empty text."""
    spec = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        coder = spec.value.coder()
        for b in batches:
            texts = []
            for x in b.column(1):
                v = np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32)
                texts.append("".join(c.decode("utf-8", "replace") for c in coder.decode(v)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return map_arrow(rows.select(F.col(key).cast("long"), F.col(ids)), run, f"{key} long, text string")


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Encode whole texts, decode the ids again; counts and SHA-256 of both, and the ids if wanted.

    One pass in Arrow batches, no shuffle; a worker holds one chunk of texts and its tables.
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(cols):
        coder = spec.value.coder()
        n, ids_sha, back_sha, flat = [], [], [], []
        for t in cols[1]:
            ids = coder.encode((t or b"").decode())
            back = hashlib.sha256()
            for part in coder.decode(np.frombuffer(ids, "<u4")):
                back.update(part)
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            back_sha.append(back.hexdigest())
            if with_ids:
                flat.append(ids)
        out = {key: pa.array(cols[0], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(back_sha)}
        if with_ids:
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            out["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(flat), "<i4")))
        return pa.RecordBatch.from_pydict(out)

    return map_chunks(docs.select(F.col(key).cast("long"), F.encode(text, "UTF-8")), run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
