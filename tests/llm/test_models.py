"""Operators 1, 2, 7, 9 and 10: against brute force where their parts have one, else by held-out accuracy."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from sparktext.llm import hmm, langid, licenses, quality, rules


def held(i, n):
    return zlib.crc32(str(i).encode()) % n == 0


# --- 1 -------------------------------------------------------------------------------------------


def mixed_corpus(seed=1, n=240):
    rng = random.Random(seed)
    vocab = [[f"{'ab'[k]}{j}{'xy'[k]}" for j in range(120)] for k in range(2)]
    rows = []
    for i in range(n):
        k = rng.randint(0, 1)
        rows.append((i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randint(5, 60))), "ab"[k]))
    return rows


def test_base_scores(spark, odd_rows):
    rows = [(i, t) for i, t, *_ in odd_rows] + [(i + 1000, t) for i, t, _ in mixed_corpus()]
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in rows}
    counts = Counter(x for i, w in tokens.items() if not held(i, 10) for x in w)
    total, kinds = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert set(got) == set(tokens)
    for i, w in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i, 10), len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = [(i, t) for i, t, _ in mixed_corpus(n=600)]
    got = [r for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_forward_and_counts_equal_enumeration():
    rng = np.random.default_rng(3)
    p = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s))
    m = hmm.HiddenMarkov(p(3), p(3, 3), p(3, 5))
    seqs = [rng.integers(0, 5, n) for n in (1, 2, 5, 4)]
    start, move, emit, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), []
    for s in seqs:
        ways = {}
        for path in itertools.product(range(3), repeat=len(s)):
            v = m.start[path[0]] * m.emit[path[0], s[0]]
            for k in range(1, len(s)):
                v *= m.move[path[k - 1], path[k]] * m.emit[path[k], s[k]]
            ways[path] = v
        total = sum(ways.values())
        logs.append(math.log10(total))
        for path, v in ways.items():
            start[path[0]] += v / total
            for k, x in enumerate(path):
                emit[x, s[k]] += v / total
                if k:
                    move[path[k - 1], x] += v / total
    assert np.allclose(m.forward(seqs), logs)
    got = m.expect([np.asarray(s, np.int64) for s in seqs])
    assert np.allclose(got[0], start) and np.allclose(got[1], move) and np.allclose(got[2], emit)


def test_scores_form_a_distribution():
    """Emissions of all words of a class, its unknown word included, sum to the class' own."""
    counts, head = {b"the": 50, b"nation": 3, b"station": 2, b"x": 1}, [b"the"]
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in counts], np.uint64).view(np.int64)
    cls = hmm.Classes(head).of(hashes, np.array([zlib.crc32(w[-3:]) % hmm.TAIL for w in counts]))
    mass = np.zeros(hmm.Classes.size)
    np.add.at(mass, cls, np.array(list(counts.values())) + 0.1)
    mass += 0.1
    for c in set(cls.tolist()):
        inside = sum((n + 0.1) / mass[c] for n, k in zip(counts.values(), cls) if k == c) + 0.1 / mass[c]
        assert math.isclose(inside, 1)
    assert cls[1] == cls[2] != cls[0] == 0


def test_scoring_edges(loose, empty):
    assert hmm.score(empty).count() == 0
    assert hmm.score(loose).count() == loose.count()


# --- 2 -------------------------------------------------------------------------------------------

SYLLABLES = {"en": ["the", "ing", "tion", "and", "er"], "fr": ["eau", "que", "oi", "ment", "é"], "de": ["sch", "ung", "keit", "ö", "ver"]}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(2)
    rows = [(i, speak(rng, lang, 60), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(150))]
    rows += [(900, None, "en"), (901, "", "fr"), (902, "12 -- !", "de"), (903, speak(rng, "fr", 9), None), (904, speak(rng, "en", 90) + " " + speak(rng, "de", 40), None), (None, speak(rng, "de", 20), "de")]
    got = {r["doc_id"]: r for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:150]) and any(got[i]["held_out"] for i in range(150))
    assert all(got[i]["held_out"] == held(i, 5) for i in range(150))
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "fr"] and got[900]["score"] == 0
    mixed = got[904]
    assert mixed["lang_pred"] == "en" and set(mixed["proportions"]) == {"en", "de"} and 0.5 < mixed["score"] < 0.85
    assert got[None]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edges(spark, odd, empty):
    assert langid.language_id(empty).count() == 0
    none = spark.createDataFrame([(1, "the text", None)], "doc_id long, text string, lang string")
    assert langid.language_id(none).first()["lang_pred"] == "und"
    assert langid.language_id(odd).count() == odd.count()


def test_letters():
    assert langid.has_letter("日".encode()) and langid.has_letter(b"1a") and not langid.has_letter("12 €²".encode()) and not langid.has_letter(b" ")


# --- 7 -------------------------------------------------------------------------------------------


def rated(seed=4, n=1500):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        kind = rng.random()
        w = speak(rng, rng.choice(list(SYLLABLES)), 80).split()
        if kind < 0.15:
            w[rng.randint(0, 79)] = w[rng.randint(0, 79)] = "scum"
        elif kind < 0.35:
            w = [x + "%%%" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not 0.15 <= kind < 0.35), int(kind < 0.15)))
    return rows, labels


def test_classifier(spark):
    rows, labels = rated()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    graded = quality.graded(spark.createDataFrame(labels[:1200] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    model = quality.train(df, graded)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r for r in quality.score(df, model).collect()}
    right = [got[i]["selected"] == (q == 1 and t == 0) for i, q, t in labels[1200:]]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r["tail_prob"] <= 1 and r["tail_prob"] <= r["expected_grade"] <= 2 for r in got.values())
    kept = {r["doc_id"] for r in quality.select(df, model).collect()}
    assert kept == {i for i, r in got.items() if r["selected"]}
    again = quality.train(df.repartition(5), graded)
    assert np.allclose(again.weights, model.weights)


def test_classifier_edges(spark, odd, empty):
    nothing = quality.graded(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    model = quality.train(odd, nothing)
    rows = {r["doc_id"]: r for r in quality.score(odd, model).collect()}
    assert not rows[100]["selected"] and not rows[101]["selected"] and len({r["tail_prob"] for i, r in rows.items() if i not in (100, 101)}) == 1
    assert quality.score(empty, model).count() == 0 and quality.select(odd, model).columns == odd.columns


def test_gradient():
    """Fitting lowers the likelihood's loss on separable grades."""
    rows = [(np.array([k]), np.ones(1, np.float32)) for k in (1, 2, 3)] * 20
    model = quality.fit(rows, np.array([0, 1, 2] * 20))
    s = model.weights[[1, 2, 3]]
    assert s[0] < model.thresholds[0] < s[1] < model.thresholds[1] < s[2]


# --- 9 -------------------------------------------------------------------------------------------


def measured(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    again = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(again)


def test_measures():
    rng = random.Random(6)
    texts = [None, "", " \n\t", "a b c a b c", "x\n\nx\n \ny", "é|日 * é|日 * é|日", "a\x1cb\x85c"] + [" ".join(rng.choice("ab#\n ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert rules.measure(t.encode() if t is not None else None)[:5] == measured(t)


@pytest.mark.parametrize("k,n", [(0, 10), (3, 20), (5, 300), (40, 41)])
def test_exact_binomial_bound(k, n):
    p = rules.upper_bound(k, n, 0.01)
    assert math.isclose(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), 0.01, rel_tol=1e-6)
    assert rules.upper_bound(n, n, 0.01) == rules.upper_bound(0, 0, 0.01) == 1


def test_rules_keep_good_documents(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        w = [f"w{rng.randint(0, 10**6)}" + ("%%%" if bad else "") for _ in range(70)]
        rows.append((i, " ".join(w), ["en", "de", None][i % 3]))
        labels.append((i, int(not bad), 0))
    rows += [(5000, None, "en"), (5001, "too short", "en"), (5002, "a b c " * 40, "en"), (5003, rows[0][1], "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in rules.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i]["kept"] == bool(q) for i, q, _ in labels)
    assert got[0]["broken"] == ["symbols"] and not got[0]["base_failed"]
    assert [got[i]["base_failed"] for i in (5000, 5001, 5002)] == [True] * 3 and got[5003]["kept"]
    for i, t, _ in rows[:50]:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measured(t)


def test_risk_holds_for_all_rules_together(spark):
    """Each rule alone may reject 1.2 % of the good documents at its cutoff; all three may not."""
    rng = random.Random(4)
    rows = []
    for i in range(9000):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
        text = {0: " ".join(x + "%%%" for x in w), 1: "\n".join([" ".join(w), *["same line"] * 8]), 2: " ".join([*w, *"a b c d e f g h i j".split() * 4])}.get(i % 83, " ".join(w))
        rows.append((i, text, "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = rules.quality_rules(docs, spark.createDataFrame([(i, 1, 0) for i, *_ in rows], "doc_id long, quality int, toxic int")).collect()
    lost = sum(not r["kept"] for r in got)
    assert lost <= 0.02 * len(rows) and any(r["broken"] for r in got)


def test_rules_edges(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.quality_rules(empty, none).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in rules.quality_rules(odd, none).collect())


# --- 10 ------------------------------------------------------------------------------------------


def test_licenses(spark, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    filler = [(100 + k, f"text number {k} of many words", f"other/{k}.txt") for k in range(60)]
    rows = [
        (1, f"MIT License\n{mit}", "a/LICENSE"), (2, "just code", "a/b/c.py"), (3, "# Licensed under the Apache License, Version 2.0.\n" + "code and more code " * 20, "a/b/d.py"), (4, "plain", "z.py"),
        (5, "Released under the MIT License.", "q/COPYING"), (6, None, "q/deep/er/x"), (7, "", None), (8, "Licensed under CC BY-NC 4.0.\n" + "words " * 30, "p/x"), (9, "the license of this city is old", "p/y"),
    ] + filler
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r["doc_id"]: (r["license"], r["how"], r["from_path"]) for r in licenses.scan(docs, "path").collect()}
    assert got[1] == ("MIT", "own", "a/LICENSE") and got[2] == ("MIT", "inherited", "a/LICENSE") and got[3] == ("Apache-2.0", "own", "a/b/d.py")
    assert got[4] == (None, None, None) and got[6] == ("MIT", "inherited", "q/COPYING") and got[7] == (None, None, None)
    assert got[8][:2] == ("CC-BY-NC-4.0", "own") and got[9] == (None, None, None)
    assert licenses.scan(empty.withColumnRenamed("source", "path"), "path").count() == 0


def test_frequent_notices_are_found(spark):
    """No share of documents with a notice, and no size of the table, hides it."""
    notice = "# Licensed under the Apache License, Version 2.0.\n"
    rows = [(k, (notice if k % 3 == 0 else "") + f"code number {k} " * 20, f"d{k}/x.py") for k in range(90)]
    for docs in (rows, rows[:3], rows[:1]):
        got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string, path string"), "path").collect()}
        assert got == {i: "Apache-2.0" if i % 3 == 0 else None for i, *_ in docs}


def test_usual_headers_are_found(spark):
    """Notices that are no template's own line: in longer lines, over line breaks, in other wordings."""
    want = {
        "Copyright (c) 2020 Foo Corp. All rights reserved.": "proprietary", "Licensed under the MIT License.": "MIT", "This code is released under the MIT License.": "MIT", "MIT License": "MIT",
        "Released under the MIT License. See LICENSE for details.": "MIT", "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
        "# Copyright 2019 A. B. Licensed under the Apache\n# License, Version 2.0 (the \"License\"); you may not\n# use this file except in compliance": "Apache-2.0",
        "Foo is free software under the GNU General Public License version 3 and comes without warranty": "GPL-3.0",
        "Copyright Foo. All rights reserved. Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met": "BSD-3-Clause",
        "the licence of this public work is old": None, "a general version of the work": None, "all rights of the city": None,
    }
    rows = [(k, t + "\n" + "plain text and more of it " * 12, f"a{k}/x") for k, t in enumerate(want)]
    rows += [(100 + k, f"the text number {k} of all the words is not under the general rule", f"b{k}/x") for k in range(200)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string"), "path").collect()}
    assert got == {k: w for k, w in enumerate(want.values())} | {100 + k: None for k in range(200)}


def test_cosine_equals_definition():
    t = licenses.Templates({"a": ("one two two",), "b": ("three four",)}, {b"one": 3, b"two": 1, b"three": 2, b"four": 0}, 10)
    idf = lambda w: math.log(11 / (1 + {"one": 3, "two": 1, "three": 2, "four": 0}.get(w, 0))) + 1
    x, y = {"one": idf("one"), "two": 2 * idf("two")}, {"two": idf("two"), "zzz": 2 * (math.log(11) + 1)}
    norm = lambda v: math.sqrt(sum(c * c for c in v.values()))
    score, name = t.match([b"two", b"zzz", b"zzz"])
    assert name == "a" and math.isclose(score, x["two"] * y["two"] / norm(x) / norm(y))
