import hashlib
import random
import re

from sparktext.llm import decontam

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=8):
    out = {}
    each = [(i, WORD.findall((t or "").encode().lower())) for i, t in items]
    for d, t in docs:
        w, hit, found = WORD.findall((t or "").encode().lower()), set(), set()
        for i, x in each:
            n = min(window, len(x))
            for q in range(len(x) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[q : q + n]:
                        hit.update(range(p, p + n))
                        found.add(i)
        names = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), names, len(found) >= 2)
    return out


def cases():
    rng = random.Random(3)
    text = lambda n, letters: " ".join(rng.choice(letters) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 8, 9, 20]), "abcDé")) for k in range(8)] + [(20, None), (21, ""), (22, "--"), (23, "x y"), (24, "x y")]
    docs = [(k, text(rng.randint(0, 60), "abcdefé") + "." + (rng.choice(items)[1] or "")) for k in range(40)] + [(90, None), (91, ""), (92, "X-Y, x y")]
    return docs, items


def rows(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


def test_equals_brute_force(spark):
    docs, items = cases()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert rows(decontam.contamination(d, i)) == want
    assert rows(decontam.contamination(d, i, limit=20)) == want  # many slices of items
    for limit in (decontam.SLICE_BYTES, 20):
        clean = {r["doc_id"] for r in decontam.decontaminate(d, i, limit=limit).collect()}
        assert clean == {k for k, v in want.items() if v[2] == 0}


def test_repeated_and_null_ids_in_any_number_of_slices(spark):
    """Rows are each reported, by their own text; rows of one item id are one item."""
    a, b = "one two three four five six seven eight", "ein zwei drei vier fünf sechs sieben acht neun"
    items = spark.createDataFrame([(1, a), (1, a), (2, b), (None, "u v w x y z q r"), (None, "u v")], "item_id long, text string")
    docs = [(1, f"{a} x"), (1, "clean"), (2, f"{a} - {b}"), (2, f"{a} - {b}"), (None, b), (None, "clean too"), (3, "u v w x y z q r s"), (4, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted([(1, 9, 8, 1, "1", False), (1, 1, 0, 0, "", False), *[(2, 17, 17, 2, "1,2", True)] * 2, (None, 9, 9, 1, "2", False), (None, 2, 0, 0, "", False), (3, 9, 8, 1, "", False), (4, 0, 0, 0, "", False)], key=str)
    for limit in (decontam.SLICE_BYTES, 20):
        got = [tuple(r)[:6] for r in decontam.contamination(d, items, limit=limit).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
        assert sorted(got, key=str) == sorted([(*w[:4], hashlib.sha256(w[4].encode()).hexdigest(), w[5]) for w in want], key=str)
        kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in decontam.decontaminate(d, items, limit=limit).collect())
        assert kept == [(0, "clean too"), (1, "clean"), (4, "")]


def test_suffix_array_and_parts(monkeypatch):
    """The order is that of the suffixes; documents with very many pairs are searched in parts."""
    import numpy as np

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))).encode() for _ in range(12)]
    items = decontam.Items([(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))).encode()) for k in range(9)], 4)
    shard = decontam.Shard(texts)
    for n in (1, 2, 3, 4, 5, 8):
        at = shard.suffixes.sorted(n)[1].tolist()
        groups = [tuple(shard.ids[p : p + n]) for p in at]
        assert groups == sorted(groups) and len(at) == sum(max(0, c - n + 1) for c in shard.counts)
    want = decontam.search(items, texts)
    plain_ = {(p, q) for p in range(len(shard.ids)) for q in range(len(items.flat)) for n in [items.size[q]] if items.flat[q : q + n].min(initial=0) >= 0 and len(items.flat[q : q + n]) == n and min(shard.ids[p : p + n].tolist(), default=-1) >= 0 and shard.ids[p : p + n].tolist() == items.numbers(shard.known)[q : q + n].tolist()}
    assert {(p, q) for n, a, b in shard.hits(items) for p, q in zip(a.tolist(), b.tolist())} == plain_
    for most in (1, 7, 60):
        monkeypatch.setattr(decontam, "PAIRS", most)
        got = decontam.search(items, texts)
        assert all((a == b).all() for a, b in zip(got[1:], want[1:]))


def test_edges(spark, odd, loose, empty):
    items = spark.createDataFrame([(1, None)], "item_id long, text string")
    none = items.limit(0)
    assert decontam.contamination(odd, none).where("n_items > 0").count() == 0
    assert decontam.contamination(loose, items).count() == loose.count()
    assert decontam.contamination(empty, items).count() == 0 and decontam.decontaminate(empty, none).count() == 0
    assert decontam.decontaminate(odd, none).columns == odd.columns


def test_longest_match(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"zero {item} eleven"), (2, "two three four five six seven eight nine x"), (3, "x")], "doc_id long, text string")
    found = decontam.find_items(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert {r["doc_id"]: (r["longest"], r["starts"], r["ends"]) for r in found.collect()} == {1: (10, [1], [11]), 2: (8, [0], [8]), 3: (0, [], [])}
    assert {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in found.collect()} == {1: [(1, "5", 0, 10)], 2: [(0, "5", 1, 8)], 3: []}
