"""Operator 1: a hidden Markov language model scores whole texts.

Tokens are words (A-Z lower-cased) and one end per text. A hidden state emits a word class, the class
emits the word: P(w | state) = P(class | state) * (c(w) + 0.1) / (mass of the class), with one unknown
word for each class. Classes are the ``HEAD`` most frequent words, each alone, and the other words by
their last three bytes; so every state's emissions have a fixed size, while word counts, which grow
with the corpus, stay in Spark tables and are joined, never broadcast.

Baum-Welch runs over all training documents: each step takes one share of them (chosen by their hash),
expected counts of its partitions are summed by Spark, and steps are blended (stepwise EM), so ``PASSES``
passes over the corpus give ``PASSES * SHARES`` steps. For training, long documents are cut in segments
of ``SEGMENT`` tokens (no token is left out); scoring runs the scaled forward recursion over
the whole sequence, so it is the exact likelihood under the model.

Texts are coded once: a block (some MB of texts) keeps its own list of words and its documents as
indices. Words are counted and joined once per block, not once per token: a word in a third of all
texts is one row per block.

Edge cases: null and empty texts have the end token only; if nothing is in training, counts are 0 and
only unknown words remain; a null doc_id is scored and held in training. Repeated rows count each time; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, map_arrow, release, table

HEAD = 4096
TAIL = 4096
STATES = 8
SHARES = 3
PASSES = 2
SEGMENT = 512
BLOCK_BYTES = 16 << 20
END = b""



def _columns(shares: int) -> list[tuple[str, pa.DataType, str]]:
    """Columns of a block. Group g < shares are training documents of that share, the last group those
    that are held out; a training step reads its own group only."""
    fixed = [("block", pa.int64(), "long"), ("words", pa.list_(pa.binary()), "array<binary>"), ("n", pa.list_(pa.int64()), "array<long>"), ("hash", pa.list_(pa.int64()), "array<long>"), ("tail", pa.list_(pa.int32()), "array<int>")]
    return fixed + [c for g in range(shares + 1) for c in ((f"ids{g}", pa.list_(pa.int64()), "array<long>"), (f"codes{g}", pa.list_(pa.binary()), "array<binary>"))]


def encode(docs: DataFrame, folds: int = 10, shares: int = SHARES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Blocks of documents: the block's words with their training counts, hashes and tail classes; per
    group its documents' ids and their tokens as indices of the words."""
    crc = F.crc32(F.col(key).cast("string"))
    group = F.when(crc % folds == 0, F.lit(shares)).otherwise(F.floor(crc / folds) % shares)
    rows = docs.select(F.col(key).cast("long"), F.encode(text, "UTF-8"), F.coalesce(group, F.lit(0)).cast("int"))
    columns = _columns(shares)

    def run(batches):
        part, count = TaskContext.get().partitionId(), 0
        crc32, h64 = zlib.crc32, xxhash.xxh64_intdigest
        for ids, texts, groups in chunks(batches, 1, BLOCK_BYTES):
            words: dict[bytes, int] = {END: 0}
            add, codes = words.setdefault, []
            for t in texts:
                w = t.lower().split() if t else []
                c = [add(x, len(words)) for x in w]
                c.append(0)
                codes.append(np.array(c, "<i4"))
            train = [c for c, g in zip(codes, groups) if g < shares]
            n = np.bincount(np.concatenate(train), minlength=len(words)) if train else np.zeros(len(words), np.int64)
            row = [(part << 32) | count, list(words), n, np.array([h64(w) for w in words], np.uint64).view(np.int64), np.array([crc32(w[-3:]) % TAIL for w in words], np.int32)]
            for g in range(shares + 1):
                mine = [k for k, x in enumerate(groups) if x == g]
                row += [[ids[k] for k in mine], [codes[k].tobytes() for k in mine]]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t, _) in zip(row, columns)], names=[c[0] for c in columns])
            count += 1

    return map_arrow(rows, run, ", ".join(f"{n} {t}" for n, _, t in columns))


class Classes:
    """Word classes: the most frequent words alone, the others by their last bytes."""

    size = HEAD + TAIL

    def __init__(self, head: list[bytes]):
        h = np.array([xxhash.xxh64_intdigest(w) for w in head], np.uint64).view(np.int64)
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]

    def of(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Classes of words given by their hashes and tail classes."""
        out = tails.astype(np.int32) + HEAD
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.order[at[hit]]
        return out


class HiddenMarkov:
    """start (states), move (states x states), emit (states x classes)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, mass: np.ndarray, states: int = STATES, seed: int = 5) -> HiddenMarkov:
        """Sticky states, each with the corpus' class shares shaken at random."""
        rng = np.random.default_rng(seed)
        emit = (mass / mass.sum()) * np.exp(rng.normal(0, 0.7, (states, len(mass))))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    def forward(self, seqs: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each class sequence: scaled forward recursion, in step for all."""
        size = np.array([len(s) for s in seqs])
        order = np.argsort(-size, kind="stable")
        out = np.zeros(len(seqs))
        if not len(seqs):
            return out
        size = size[order]
        flat = np.concatenate([seqs[k] for k in order])
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
        emit = np.ascontiguousarray(self.emit.T)
        log, a = np.zeros(len(seqs)), None
        scale = np.ones(len(seqs))
        for k, n in enumerate(active.tolist()):
            a = self.start * emit[flat[at[:n]]] if a is None else (a[:n] @ self.move) * emit[flat[at[:n] + k]]
            total = a.sum(1)
            a /= total[:, None]
            scale[:n] *= total
            if k % 16 == 15 or n < 64:
                log += np.log10(scale)
                scale[:] = 1
        out[order] = log + np.log10(scale)
        return out

    def expect(self, seqs: list[np.ndarray]):
        """Expected counts (start, move, emit) of segments of equal treatment: forward and backward."""
        states, classes = self.emit.shape
        start, move, emission = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
        emit = np.ascontiguousarray(self.emit.T)
        order = sorted(range(len(seqs)), key=lambda k: -len(seqs[k]))
        lo = 0
        while lo < len(order):
            total, hi = 0, lo
            while hi < len(order) and (hi == lo or total + len(seqs[order[hi]]) <= 500_000):
                total += len(seqs[order[hi]])
                hi += 1
            group = [seqs[k] for k in order[lo:hi]]
            lo = hi
            size = np.array([len(s) for s in group])
            active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
            at = np.concatenate([[0], np.cumsum(size)])[:-1]
            flat = np.concatenate(group)
            # time-major: step k holds the segments that are longer than k
            index = np.concatenate([at[:n] + k for k, n in enumerate(active.tolist())])
            cls = flat[index]
            e = emit[cls]
            step = np.concatenate([[0], np.cumsum(active)])
            alpha = np.empty_like(e)
            scale = np.empty(len(e))
            for k, n in enumerate(active.tolist()):
                s = slice(step[k], step[k] + n)
                a = (self.start if k == 0 else alpha[step[k - 1] : step[k - 1] + n] @ self.move) * e[s]
                c = a.sum(1)
                scale[s] = c
                np.divide(a, c[:, None], out=alpha[s])
            gamma = alpha.copy()
            beta = np.ones((len(group), states))
            for k in range(len(active) - 1, 0, -1):
                n, p = active[k], active[k - 1]
                s = slice(step[k], step[k] + n)
                x = e[s] * beta[:n] / scale[s][:, None]
                prev = alpha[step[k - 1] : step[k - 1] + n]
                move += (prev.T @ x) * self.move
                beta[:n] = x @ self.move.T
                gamma[step[k - 1] : step[k - 1] + n] *= beta[:n]
            start += gamma[: active[0]].sum(0)
            for j in range(states):
                emission[j] += np.bincount(cls, gamma[:, j], classes)
        return start, move, emission


def _sequences(codes: pa.ListScalar) -> list[np.ndarray]:
    """Word indices of each document of a group."""
    return [np.frombuffer(x.as_buffer(), "<i4") for x in codes.values]


def _segments(codes: np.ndarray) -> list[np.ndarray]:
    return [codes[k : k + SEGMENT] for k in range(0, len(codes), SEGMENT)]


def expected_counts(blocks: DataFrame, model: HiddenMarkov, classes: Classes, share: int) -> dict[tuple[int, int, int], float]:
    """Baum-Welch counts of one share of the training documents, summed over partitions by Spark:
    (kind, row, column) to count. Its size is fixed by states and classes."""
    held = blocks.sparkSession.sparkContext.broadcast((model, classes))

    def run(batches):
        m, c = held.value
        sums = None
        for b in batches:
            for k in range(b.num_rows):
                hashes, tails, codes = (b.column(j)[k] for j in range(3))
                if not len(codes):
                    continue
                cls = c.of(hashes.values.to_numpy(), tails.values.to_numpy())
                got = m.expect([x for s in _sequences(codes) for x in _segments(cls[s])])
                sums = got if sums is None else [a + g for a, g in zip(sums, got)]
        if sums is not None:
            for kind, x in enumerate((sums[0][None, :], sums[1], sums[2])):
                i, j = np.nonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(x[i, j])], names=["kind", "i", "j", "x"])

    rows = map_arrow(blocks.select("hash", "tail", f"codes{share}"), run, "kind int, i int, j int, x double").groupBy("kind", "i", "j").agg(F.sum("x").alias("x")).toArrow()
    return [rows.column(k).to_numpy() for k in range(4)]


def train(blocks: DataFrame, classes: Classes, mass: np.ndarray, states: int = STATES, shares: int = SHARES, passes: int = PASSES, prior: float = 20.0) -> HiddenMarkov:
    """Stepwise Baum-Welch; emissions are smoothed towards the corpus' class shares."""
    model = HiddenMarkov.first(mass, states)
    base = mass / mass.sum()
    held = None
    for step in range(passes * shares):
        kind, i, j, x = expected_counts(blocks, model, classes, step % shares)
        new = [np.zeros(states), np.zeros((states, states)), np.zeros((states, len(mass)))]
        new[0][j[kind == 0]] = x[kind == 0]
        new[1][i[kind == 1], j[kind == 1]] = x[kind == 1]
        new[2][i[kind == 2], j[kind == 2]] = x[kind == 2]
        if not new[2].sum():
            continue
        # old counts fade out: the share of step t is about 1 / (t + 1) ** 0.6
        keep = 0 if held is None else 1 - (step + 1) ** -0.6
        held = new if held is None else [keep * a + (1 - keep) * b for a, b in zip(held, new)]
        start = (held[0] + 0.1) / (held[0] + 0.1).sum()
        move = (held[1] + 0.1) / (held[1] + 0.1).sum(1, keepdims=True)
        emit = held[2] + prior * base
        model = HiddenMarkov(start, move, emit / emit.sum(1, keepdims=True))
    return model


def score(docs: DataFrame, folds: int = 10, states: int = STATES, shares: int = SHARES, passes: int = PASSES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score (the add-0.1 unigram's
    log10 probability), score (the hidden Markov model's)."""
    spark = docs.sparkSession
    blocks = table(encode(docs, folds, shares, text, key), "blocks", **{"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"})
    listed = blocks.select(F.explode(F.arrays_zip("words", "n")).alias("x")).select("x.words", "x.n")
    counts = table(listed.groupBy(F.col("words").alias("word")).agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # bounded: at most HEAD words, one mass per class
    head = [bytes(r[0]) for r in counts.orderBy(F.desc("c"), "word").limit(HEAD).select("word").collect()]
    classes = Classes(head)
    mass = np.zeros(Classes.size)
    tops = spark.createDataFrame([(bytearray(w), k) for k, w in enumerate(head)], "word binary, k int")
    marked = counts.join(F.broadcast(tops), "word", "left").withColumn("class", F.coalesce("k", (F.lit(HEAD) + F.crc32(F.substring("word", -3, 3)) % TAIL).cast("int")))
    for r in marked.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        mass[r["class"]] = r["c"] + 0.1 * r["v"]
    mass += 0.1  # the class' unknown word
    model = train(blocks, classes, mass, states, shares, passes)

    # the counts of each block's words, as one array a block
    places = blocks.select("block", F.posexplode("words").alias("at", "word")).join(counts, "word", "left").select("block", "at", F.coalesce("c", F.lit(0)).alias("c"))
    sorted_ = places.repartition("block").sortWithinPartitions("block", "at")

    def pack(batches):
        now, parts = None, []
        for b in batches:
            block, c = b.column(0).to_numpy(), b.column(2).to_numpy()
            cut = np.flatnonzero(np.diff(block)) + 1
            for s, e in zip([0, *cut], [*cut, len(block)]):
                if e <= s:
                    continue
                if now is not None and block[s] != now:
                    yield row(now, parts)
                    parts = []
                now = int(block[s])
                parts.append(c[s:e])
        if now is not None:
            yield row(now, parts)

    def row(block, parts):
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.concatenate(parts).astype("<i8").tobytes()], pa.binary())], names=["block", "c"])

    # written, so that the words' shuffles are gone before blocks are dealt
    packed = table(map_arrow(sorted_, pack, "block long, c binary"), "packed")
    del places, sorted_, listed, marked
    release(spark)
    groups = [c for g in range(shares + 1) for c in (f"ids{g}", f"codes{g}")]
    rows = blocks.select("block", "hash", "tail", *groups).join(packed, "block").select("hash", "tail", "c", *groups)
    given = spark.sparkContext.broadcast((model, classes, mass, int(total), int(kinds)))

    def run(batches):
        m, cl, mass, n_all, v = given.value
        lmass, base_all = np.log10(mass), np.log10(n_all + 0.1 * (v + 1))
        for b in batches:
            for k in range(b.num_rows):
                cls = cl.of(b.column(0)[k].values.to_numpy(), b.column(1)[k].values.to_numpy())
                c = np.frombuffer(b.column(2)[k].as_buffer(), "<i8")
                lc = np.log10(c + 0.1)
                inner = lc - lmass[cls]
                ids, seqs, out = [], [], []
                for g in range(shares + 1):
                    ids += b.column(3 + 2 * g)[k].as_py()
                    seqs += _sequences(b.column(4 + 2 * g)[k])
                    out += [g == shares] * (len(seqs) - len(out))
                if not seqs:
                    continue
                size = np.array([len(s) for s in seqs])
                known = np.array([int((c[s] > 0).sum()) for s in seqs])
                base = np.array([lc[s].sum() for s in seqs]) - size * base_all
                value = m.forward([cls[s] for s in seqs]) + np.array([inner[s].sum() for s in seqs])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out), pa.array(size), pa.array(known), pa.array(np.full(len(size), n_all, np.int64)), pa.array(base), pa.array(value)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return map_arrow(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
