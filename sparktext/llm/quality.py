"""Operator 7: quality classifier by ordinal cumulative-link regression.

Grades are ordered (0: toxic, 1: poor, 2: good). One weight vector over hashed text features is
shared by all grades; ordered thresholds cut its score: P(grade <= k) = sigmoid(t_k - w.x). The
expected grade and the tail probability P(grade >= good) follow; documents are selected by the tail.

The fit uses at most ``SAMPLE`` labelled documents, those whose hashed doc_id is smallest, so it does
not depend on partitions; their features (not texts) come to the driver. Weights have a fixed size
(``DIMS``) and are broadcast. Scoring is one pass over whole texts without a shuffle.

Edge cases: null texts and texts without a word have no features, expected grade 0, tail 0 and are
not selected; labels whose grade a null leaves open are left out; repeated labels count by the lower
grade; without labels, or with labels of one grade, weights are zero and the thresholds follow the grades'
counts (one added to each), so all documents with a word get the same score. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, map_chunks

#: Labelled documents that the fit uses at most.
SAMPLE = 12_000
#: Places of the hashed features.
DIMS = 1 << 18

_WORDY = bytes(c for c in range(256) if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)
_SYMBOLS = bytes(c for c in range(256) if c not in _WORDY)


class Features:
    """Hashed features of a text: its words in lower case, their letters alone, their symbols alone."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, ...]] = {}

    def of(self, word: bytes) -> tuple[int, ...]:
        bare, signs = word.translate(None, _SYMBOLS), word.translate(None, _WORDY)
        out = [zlib.crc32(word)]
        if signs and bare:
            out += [zlib.crc32(b"w " + bare), zlib.crc32(b"s " + signs)]
        elif bare:
            out.append(zlib.crc32(b"w " + bare))
        return tuple(x % DIMS for x in out)

    def __call__(self, data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Places, and values log(1 + count) scaled to length 1."""
        words = data.lower().split() if data else []
        if len(self.known) > 300_000:
            self.known.clear()
        known, flat = self.known, []
        for w in words:
            f = known.get(w)
            if f is None:
                f = known[w] = self.of(w)
            flat += f
        place, n = np.unique(np.array(flat, np.int32), return_counts=True)
        x = np.log1p(n).astype(np.float32)
        return place, x / np.sqrt((x * x).sum()) if len(x) else x


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int = 3, epochs: int = 12, batch: int = 128, rate: float = 0.5, ridge: float = 1e-5, seed: int = 7) -> OrdinalModel:
    """Adagrad on the cumulative-link likelihood; thresholds stay ordered as base plus positive steps."""
    w, g2 = np.zeros(DIMS), np.full(DIMS, 1e-6)
    counts = np.bincount(grades, minlength=n_grades) + 1.0
    below = np.cumsum(counts)[:-1] / counts.sum()
    t = np.log(below / (1 - below))
    u = np.concatenate([[t[0]], np.log(np.maximum(np.diff(t), 1e-3))])  # base, log steps
    gu = np.full(len(u), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs if len(np.unique(grades)) > 1 else 0):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            place = np.concatenate([rows[r][0] for r in pick])
            x = np.concatenate([rows[r][1] for r in pick])
            who = np.repeat(np.arange(len(pick)), [len(rows[r][0]) for r in pick])
            s = np.bincount(who, w[place] * x, len(pick))
            y = grades[pick]
            t = np.cumsum(np.concatenate([[u[0]], np.exp(u[1:])]))
            cum = 1 / (1 + np.exp(np.clip(s[:, None] - t[None, :], -40, 40)))  # P(grade <= k)
            full = np.concatenate([np.zeros((len(pick), 1)), cum, np.ones((len(pick), 1))], 1)
            row = np.arange(len(pick))
            p = np.maximum(full[row, y + 1] - full[row, y], 1e-9)
            d = cum * (1 - cum)
            dens = np.concatenate([np.zeros((len(pick), 1)), d, np.zeros((len(pick), 1))], 1)
            # loss -log p; p depends on t_y and t_(y-1)
            gs = (dens[row, y + 1] - dens[row, y]) / p / len(pick)
            gt = np.zeros(len(t) + 2)
            np.add.at(gt, y + 1, -dens[row, y + 1] / p / len(pick))
            np.add.at(gt, y, dens[row, y] / p / len(pick))
            gt = gt[1:-1]
            g_u = np.cumsum(gt[::-1])[::-1] * np.concatenate([[1.0], np.exp(u[1:])])
            gw = np.bincount(place, gs[who] * x, DIMS)
            at = np.unique(place)
            gw = gw[at] + ridge * w[at]
            g2[at] += gw * gw
            w[at] -= rate * gw / np.sqrt(g2[at])
            gu += g_u * g_u
            u -= 0.1 * g_u / np.sqrt(gu)
    return OrdinalModel(w, np.cumsum(np.concatenate([[u[0]], np.exp(u[1:])])))


def graded(labels: DataFrame, key: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """doc_id and grade: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2)
    rows = labels.select(F.col(key).cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id is not null and grade is not null")
    return rows.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents."""
    # the sample is bounded by its parameter, so it may be broadcast; texts are not shuffled
    picked = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("t")).join(F.broadcast(picked), "doc_id").select("grade", "t")

    def features(cols):
        make = Features()
        found = [make(t) for t in cols[1]]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())], names=["grade", "place", "x"])

    got = map_chunks(rows, features, "grade int, place binary, x binary").collect()
    got.sort(key=lambda r: (bytes(r[1]), bytes(r[2]), r[0]))  # the fit doesn't depend on partitions
    vectors = [(np.frombuffer(r[1], "<i4"), np.frombuffer(r[2], "<f4")) for r in got]
    return fit(vectors, np.array([r[0] for r in got], np.int64))


def score(docs: DataFrame, model: OrdinalModel, tail: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: expected_grade, tail_prob = P(grade >= 2), selected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(cols):
        judge = judge_of(held.value, tail)
        expected, good, keep = judge(cols[1])
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(expected), pa.array(good), pa.array(keep)], names=["doc_id", "expected_grade", "tail_prob", "selected"])

    return map_chunks(docs.select(F.col(key).cast("long"), F.encode(text, "UTF-8")), run, "doc_id long, expected_grade double, tail_prob double, selected boolean")


def judge_of(model: OrdinalModel, tail: float):
    """A function from a list of texts (bytes) to expected grades, tail probabilities and selections."""
    make = Features()

    def judge(texts):
        s, words = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for k, t in enumerate(texts):
            place, x = make(t)
            words[k] = len(place) > 0
            s[k] = model.weights[place] @ x
        tails = model.tails(s) * words[:, None]
        return tails.sum(1), tails[:, -1], words & (tails[:, -1] >= tail)

    return judge


def select(docs: DataFrame, model: OrdinalModel, tail: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that are selected, all their columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        judge = judge_of(held.value, tail)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = [t.encode() if t is not None else None for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(judge(texts)[2]))

    return map_arrow(docs, run, docs.schema)
