"""Operator 2: language identification as a mixture of languages.

Training counts byte n-grams (hashed to ``BUCKETS`` places) per language over all learning
documents; the counts are added by Spark, one row per language and place, so the model's size is
fixed by the number of languages. A document is a mixture of languages that each emit n-grams;
expectation-maximisation estimates the proportions. The language set is selected by penalised
likelihood: from the best single language on, the language that raises the likelihood most is added
while the gain is more than the penalty of one more proportion.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and empty proportions;
a text whose letters give no n-gram of the model falls to the languages' priors; if nothing can be
learnt (no labelled rows) every row is ``und``. Languages are learnt from non-null names only; ties
go to the language that sorts first. Rows stay as they are, repeated doc_ids included; extra columns
are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, map_chunks

BUCKETS = 1 << 15
#: A model of more languages than this is refused: it would no longer be small.
MAX_LANGUAGES = 512

#: ASCII letters in lower case, bytes beyond ASCII as they are, all else a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_NOT_ASCII = re.compile(rb"[\x80-\xff]")


def has_letter(data: bytes) -> bool:
    """Whether a text (its bytes) has a letter of any script."""
    if data.translate(_TABLE).strip() == b"":
        return False
    if re.search(rb"[A-Za-z]", data):
        return True
    return any(map(str.isalpha, data.decode("utf-8", "replace")))


def grams(data: bytes) -> np.ndarray:
    """Hashed byte trigrams of the words, each word with a space before and after."""
    text = b" " + b" ".join(data.translate(_TABLE).split()) + b" "
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (h * np.uint32(2654435761)) >> np.uint32(32 - 15)


class MixtureModel:
    """Languages, their log-priors and log-probabilities of n-grams."""

    def __init__(self, languages: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.languages = languages
        total = counts.sum(1, keepdims=True)
        self.p = (counts + smooth) / (total + smooth * counts.shape[1])
        self.logp = np.log(self.p)

    def infer(self, g: np.ndarray, penalty: float = 3.0, rounds: int = 12) -> tuple[list[int], np.ndarray]:
        """The selected languages and their proportions for one document's n-grams."""
        k = len(self.languages)
        c = np.bincount(g, minlength=self.p.shape[1])
        seen = np.flatnonzero(c)
        c = c[seen].astype(float)
        if not len(seen):
            return [0], np.ones(1)
        single = self.logp[:, seen] @ c
        chosen = [int(np.argmax(single))]
        best, share = single[chosen[0]], np.ones(1)
        if k == 1:
            return chosen, share
        n = c.sum()
        p = self.p[:, seen]
        cost = penalty * np.log(n + 1)
        while len(chosen) < k:
            # gain of a little of each language: what its n-grams would add over the mixture
            mixed = share @ p[chosen]
            slope = (p / mixed) @ c / n - 1
            slope[chosen] = -1
            add = int(np.argmax(slope))
            if slope[add] <= 0:
                break
            tried = [*chosen, add]
            q = p[tried]
            w = np.append(share * 0.8, 0.2)
            for _ in range(rounds):
                r = q * w[:, None]
                w = r @ (c / r.sum(0)) / n
            value = np.log(w @ q) @ c
            if value - best <= cost:
                break
            chosen, share, best = tried, w, value
        return chosen, share


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> MixtureModel | None:
    """n-gram counts of each language over all rows with a language."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, F.encode(text, "UTF-8"))

    def count(cols):
        names, out = sorted(set(cols[0])), []
        at = {x: k for k, x in enumerate(names)}
        total = np.zeros((len(names), BUCKETS), np.int64)
        for x, t in zip(*cols):
            total[at[x]] += np.bincount(grams(t), minlength=BUCKETS)
        who, place = np.nonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in who], pa.string()), pa.array(place.astype(np.int32)), pa.array(total[who, place])], names=["lang", "place", "n"])

    # partial sums per chunk of texts, then by Spark
    counts = map_chunks(rows, count, "lang string, place int, n long", limit=32 << 20).groupBy("lang", "place").agg(F.sum("n").alias("n"))
    by = counts.groupBy("lang").agg(F.collect_list(F.struct("place", "n")).alias("c")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(by) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not by:
        return None
    total = np.zeros((len(by), BUCKETS))
    for k, r in enumerate(by):
        for place, n in r["c"]:
            total[k, place] = n
    return MixtureModel([r["lang"] for r in by], total)


def identify(docs: DataFrame, model: MixtureModel | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: held_out is passed on if there; lang_pred, score, and the selected languages' proportions."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    with_held = "held_out" in docs.columns
    rows = docs.select(F.col(key).cast("long"), F.encode(text, "UTF-8"), (F.col("held_out") if with_held else F.lit(False)))

    def run(cols):
        m = held.value
        pred, score, shares = [], [], []
        for t in cols[1]:
            if m is None or t is None or not has_letter(t):
                pred.append("und")
                score.append(0.0)
                shares.append([])
                continue
            chosen, w = m.infer(grams(t))
            top = int(np.argmax(w))
            pred.append(m.languages[chosen[top]])
            score.append(min(1.0, max(0.0, float(w[top]))))
            shares.append(sorted((m.languages[c], float(x)) for c, x in zip(chosen, w)))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(pred), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "held_out", "lang_pred", "score", "proportions"])

    return map_chunks(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, proportions map<string,double>")


def language_id(docs: DataFrame, folds: int = 5, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Learn from documents whose crc32(doc_id) mod ``folds`` is not 0, predict all."""
    marked = docs.select(F.col(key), F.col(text), F.col(lang), F.coalesce(crc_mod(key, folds) == 0, F.lit(False)).alias("held_out"))
    model = learn(marked.where(~F.col("held_out")), text, lang)
    return identify(marked, model, text, key)
