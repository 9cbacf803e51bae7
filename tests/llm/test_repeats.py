"""Operators 5 and 8 against brute force, with every way that frequent strings are dealt."""

import hashlib
import random

import pytest

from sparktext.llm import phrases, suffixdedup


def removed(rows, units, width, glue):
    """doc_id: (kept, units, removed units, runs) with all windows seen in the order of documents."""
    seen, out = set(), {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        u = units(t or "")
        gone = bytearray(len(u))
        for s in range(len(u) - width + 1):
            w = tuple(u[s : s + width])
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        kept = glue([x for x, g in zip(u, gone) if not g])
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (hashlib.sha256(kept).hexdigest(), len(u), sum(gone), runs)
    return out


def corpus(seed, text):
    rng = random.Random(seed)
    line, short, long = text(rng, 150), text(rng, 80), "a " * 200
    rows = []
    for k in range(50):
        t = text(rng, rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice([line, short, long[: rng.randint(0, 400)], text(rng, 40)]) + text(rng, rng.randint(0, 120))
        rows.append((k, t))
    return rows + [(90, None), (91, ""), (92, rows[3][1]), (93, rows[3][1]), (94, rows[5][1] + "x"), (95, "é" * 150), (96, "zé" + "é" * 150)]


OPS = {
    "bytes": (suffixdedup, lambda t: t.encode(), 100, bytes, lambda rng, n: "".join(rng.choice("abcdefgh \n") for _ in range(n))),
    "words": (phrases, lambda t: t.encode().split(), 20, b" ".join, lambda rng, n: " ".join(rng.choice("abcdefgh") for _ in range(n // 4)) + " "),
}


@pytest.mark.parametrize("kind", OPS)
@pytest.mark.parametrize("hot", [100_000, 8, 1])
def test_equals_brute_force(spark, kind, hot, monkeypatch):
    module, units, width, glue, text = OPS[kind]
    rows = corpus(7, text)
    marks = module.marks
    monkeypatch.setattr(module, "marks", lambda d, t, k: marks(d, t, k, hot))
    want = removed(rows, units, width, glue)
    df = spark.createDataFrame([*rows, (None, rows[3][1])], "doc_id long, text string").repartition(7)
    for r in module.digest(df).collect():
        size = r["n_bytes"] if kind == "bytes" else r["n_words"]
        if r["doc_id"] is None:
            assert r["n_removed"] == 0 and size > 0
            continue
        assert (r["kept_sha256"], size, r["n_removed"]) == want[r["doc_id"]][:3]
        assert kind == "words" or r["n_spans"] == want[r["doc_id"]][3]


def test_edges(odd, loose, empty, odd_rows):
    for module in (suffixdedup, phrases):
        assert module.digest(empty).count() == 0
        assert module.digest(loose).count() == loose.count()
    want = removed([(i, t) for i, t, *_ in odd_rows], lambda t: t.encode(), 100, bytes)
    assert {r["doc_id"]: r["kept_sha256"] for r in suffixdedup.digest(odd).collect()} == {i: v[0] for i, v in want.items()}
    texts = {r["doc_id"]: r for r in suffixdedup.remove(odd).collect()}
    assert suffixdedup.remove(odd).columns == odd.columns and texts[100]["text"] is None and texts[103]["text"] == ""
    assert texts[0]["text"] == odd_rows[0][1] and texts[4]["n_chars"] == len(texts[4]["text"]) < len(odd_rows[4][1])
    kept = {r["doc_id"]: r["text"] for r in phrases.texts(odd).collect()}
    assert kept[100] is None and kept[103] == "" and kept[0] == " ".join(odd_rows[0][1].split())


def test_blind_trie_and_quicksort():
    import numpy as np

    rng = random.Random(2)
    for letters in (b"ab", b"abcdefgh"):
        rows = [bytes(rng.choice(letters) for _ in range(24)) for _ in range(80)]
        rows += rows[:9] + [rows[0][:20] + b"zzzz"]
        assert [rows[k] for k in suffixdedup.blind_trie(rows)] == sorted(rows)
        for shallow in (8, 16, 24):
            order, lcp = suffixdedup.deep_shallow(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 24), shallow)
            got = [rows[k] for k in order]
            assert got == sorted(rows)
            assert lcp[1:].tolist() == [suffixdedup.common(a, b) for a, b in zip(got, got[1:])]


def test_occurrences_in_slices(monkeypatch):
    import numpy as np

    rng = random.Random(4)
    ids = np.array([rng.randint(0, 2) * 34_567 for _ in range(400)], np.int32)  # several letters a word
    starts, ends, at = np.array([0, 150]), np.array([150, 400]), np.array([3, 60, 200, 311])
    want = [s for a, b in zip(starts, ends) for s in range(a, b - 7) if any((ids[s : s + 8] == ids[p : p + 8]).all() for p in at)]
    for most in (1, 3, 100):
        monkeypatch.setattr(phrases, "PHRASES", most)
        assert phrases.occurrences(ids, starts, ends, at).tolist() == want


def test_results_come_from_the_automaton(monkeypatch):
    """Without what the automaton reports nothing is found; with it, places in documents that don't name the phrase are."""
    import numpy as np

    rng = random.Random(6)
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(40))
    texts = [(" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30)) + " " + passage).encode() for _ in range(4)]
    hs = [np.unique(phrases._anchors([t])[1].view(np.int64)).tolist() for t in texts]
    both = sorted(set(hs[0]) & set(hs[1]))
    cols = [[1, 2, 3, 4], texts, [both, both, [], []], [[]] * 4]
    out = phrases._windows(cols).to_pylist()
    assert {r["doc_id"] for r in out if r["h"] is None} == {2, 3, 4} and {r["doc_id"] for r in out if r["h"] is not None} >= {1}
    auto = phrases.automaton
    monkeypatch.setattr(phrases, "automaton", lambda names: auto({"~"}))
    assert phrases._windows(cols).num_rows == 0


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(phrases, "mix", lambda x: x * np.uint64(0))
    ids = np.array([*range(40), *range(20), *range(5, 25)], np.int32)
    start, back = np.array([0, 40, 60, 20, 5]), np.array([3, 3, 3, 3, 3])
    assert phrases._again(ids, start, back).tolist() == [False, True, False, False, True]
