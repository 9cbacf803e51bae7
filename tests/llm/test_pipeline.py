"""The pipeline on planted cases, and its later stages against brute force on what reaches them."""

import hashlib
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tiktoken = pytest.importorskip("tiktoken")

from .test_models import SYLLABLES, speak  # noqa: E402


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(21)
    docs, labels, kind = [], [], {}

    def put(text, what, label=None):
        i = len(docs)
        docs.append((i, text, "en", f"s{i % 3}", len(text or "")))
        kind[i] = what
        if label is not None:
            labels.append((i, *label))
        return i

    for _ in range(700):  # what the classifier learns from
        w = speak(rng, rng.choice(list(SYLLABLES)), 70).split()
        r = rng.random()
        if r < 0.2:
            for p in rng.sample(range(70), 3):
                w[p] = rng.choice(["scum", "moron"])
            put(" ".join(w), "toxic", (1, 1))
        elif r < 0.4:
            put(" ".join(x + "%%%" for x in w), "junk", (0, 0))
        else:
            put(" ".join(w), "clean", (1, 0))
    for _ in range(20):
        w = speak(rng, "en", 70).split()
        w[5] = w[40] = "scum"
        put(" ".join(w), "toxic")
    for _ in range(10):
        w = speak(rng, "en", 200).split()
        put(" ".join(w), "clean")
        put(" ".join(w), "copy")
        w[100] = "changed"
        put(" ".join(w), "copy")
    passage = speak(rng, "en", 60)
    first = put(speak(rng, "en", 80) + "\n" + passage, "clean")
    later = [put(speak(rng, "en", 80) + "\n" + passage + "\n" + speak(rng, "en", 80), "passage") for _ in range(5)]
    items = [(k, speak(rng, "fr", 30)) for k in range(6)]
    for _, t in items:
        put(speak(rng, "fr", 60) + " " + t + " " + speak(rng, "fr", 60), "leak")
    put(None, "null")
    put("", "null")
    d = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs, kind, passage, first, later


def test_stages(spark, planted):
    d, docs, kind, passage, first, later = planted
    at = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, d).cache()
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({r["doc_id"]: r for r in at.collect()})
    texts = {i: t for i, t, *_ in docs}
    ids = lambda *what: {i for i, k in kind.items() if k in what}
    # 1: toxic, poor and empty texts go, the others stay
    good = ids("clean", "copy", "passage", "leak")
    assert len(good - set(seen[0])) <= 0.02 * len(good) and len(set(seen[0]) - good) <= 0.03 * len(ids("toxic", "junk"))
    assert not set(seen[0]) & ids("null")
    # 2: copies go
    assert not set(seen[1]) & ids("copy") and set(seen[0]) - set(seen[1]) <= ids("copy")
    # 3: against brute force on what came in
    strings = set()
    for i in sorted(seen[1]):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in strings:
                gone[s : s + 100] = b"\1" * 100
            strings.add(b[s : s + 100])
        want = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        assert seen[2][i]["text"] == want and seen[2][i]["n_chars"] == len(want)
    assert passage in seen[2][first]["text"] and not any(passage in seen[2][i]["text"] for i in later if i in seen[2])
    # 4: leaks go, nothing else
    assert set(seen[2]) - set(seen[3]) == ids("leak") & set(seen[2])


def test_run(spark, planted):
    import public_tokenizers as P
    from sparktext.llm import bpe

    d = planted[0]
    rows = corpus_pipeline.run(spark, d).collect()
    ranks = bpe.load_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read().splitlines())
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(rows) > 300
    for r in rows[:50]:
        text = reference.decode(r["ids"])
        assert hashlib.sha256(text.encode()).hexdigest() == r["decoded_sha256"] and reference.encode_ordinary(text) == r["ids"]


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_short_items_remove_no_common_words(spark, tmp_path):
    """A one-word item leaves documents that have the word; one that is mostly short items goes."""
    long = "one two three four five six seven eight nine"
    spark.createDataFrame([(1, "the"), (2, "of all"), (3, long)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "see the old town of all towns in summer again and again"), (2, f"the {long} " + "word " * 50), (3, "The answer"), (4, "none")], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path)).collect()} == {1, 4}
