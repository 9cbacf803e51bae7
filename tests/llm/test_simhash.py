import random

import numpy as np
import pytest
import xxhash

from sparktext.llm import simhash


def plain(text, size=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    size = min(size, len(w))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + size]), seed=42) for k in range(len(w) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, limit):
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= limit:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


def test_keys_meet_all_links():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
    for bits in range(simhash.MAX_BITS + 1):
        b = a.copy()
        for k in range(len(b)):
            for p in rng.choice(64, bits, replace=False):
                b[k] ^= np.uint64(1) << np.uint64(p)
        x, y = (set(zip(*(v.tolist() for v in simhash.keys_of(f)))) for f in (a, b))
        assert len({row for row, _ in x & y}) == len(a)


def test_golay_neighbours():
    """A word's indices are those of all codewords within distance 4."""
    words = np.arange(4096, dtype=np.int64) << 11
    code = words | simhash._syndrome(words)
    assert sorted(np.bincount(np.bitwise_count(code)).tolist()) == sorted([1, 0, 0, 0, 0, 0, 0, 253, 506, 0, 0, 1288, 1288, 0, 0, 506, 253, 0, 0, 0, 0, 0, 0, 1])
    rng = np.random.default_rng(2)
    for v in rng.integers(0, 1 << 23, 200):
        near = {int(c) >> 11 for c in code[np.bitwise_count(code ^ v) <= 4]}
        assert {int(v >> 11) ^ int(x) for x in simhash._DECODER[simhash._syndrome(np.array([v]))[0]]} == near


@pytest.mark.parametrize("block", [4096, 3])
def test_clusters(spark, block):
    """Chains and balls of fingerprints, near and far; small blocks deal one bucket to many tasks."""
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            if rng.random() < 0.8:
                for p in rng.sample(range(64), rng.randint(1, 5)):
                    f ^= 1 << p
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(k, 1, s) for k, s in enumerate(signed)], "node long, size long, f0 long")
    want = groups(fps, 4)
    first = {}
    for k, f in enumerate(fps):
        first.setdefault(want[f], k)
    got = {r["node"]: r["cluster"] for r in simhash.clusters(nodes, block=block).collect()}
    assert got == {k: first[want[f]] for k, f in enumerate(fps)}


def test_documents(odd, loose, empty, odd_rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    fps = {i: plain(t) for i, t, *_ in odd_rows}
    near = groups(sorted(set(fps.values())), 4)
    first = {}
    for i in sorted(fps):
        first.setdefault(near[fps[i]], i)
    assert got == {i: (f"{f:016x}", first[near[f]]) for i, f in fps.items()}
    assert got[100] == ("0" * 16, 100) and got[101] == ("0" * 16, 100)
    rows = simhash.near_duplicates(loose).collect()
    assert len(rows) == loose.count() and [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(empty).count() == 0


def test_deduplicate_keeps_one_of_near_copies(spark):
    rng = random.Random(8)
    rows, k = [], 0
    for _ in range(20):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
        rows.append((k, " ".join(w)))
        for copy in range(3):
            c = [*w]
            for p in rng.sample(range(300), copy):  # 0 to 2 words differ: similarity 1 to 0.94
                c[p] = "other"
            rows.append((k + 1 + copy, " ".join(c)))
        k += 4
    rows += [(1000 + j, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(100))) for j in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.deduplicate(df).collect()}
    assert kept == {4 * j for j in range(20)} | {1000 + j for j in range(30)}
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_deduplicate_finds_appended_and_deleted_text(spark):
    rng = random.Random(9)
    rows = []
    for k in range(40):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(200, 600))]
        more = [f"x{rng.randint(0, 10**6)}" for _ in range(len(w) * (10, 15, 18)[k % 3] // 100)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + more if k % 2 else w[: len(w) - len(more)]))]
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * k for k in range(40)} <= kept and len(kept) <= 42  # chance of the bits: about one in fifty has no key


def jaccard(a, b, size=5):
    x, y = ({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_deduplicate_keeps_texts_below_the_similarity(spark):
    """Texts at 0.65 to 0.78 mostly pass the limit of bits; they are no copies. Nor are texts of one
    fingerprint (a shingle outweighs the rest) with other words."""
    rng = random.Random(10)
    rows = []
    for k in range(60):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:270] + [f"y{rng.randint(0, 10**6)}" for _ in range(30 + k % 3 * 10)]))]
        assert 0.65 < jaccard(rows[-2][1], rows[-1][1]) or k % 3
    low = {i + 1 for (i, a), (_, b) in zip(rows[::2], rows[1::2]) if jaccard(a, b) < 0.8}
    assert len(low) >= 40
    for k in (200, 201):
        rows.append((k, "same " * 500 + " ".join(f"z{k}{j}" for j in range(100))))
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, _ in rows} - kept <= {i + 1 for i, _ in rows[:120:2]} - low


@pytest.mark.parametrize("block", [4096, 3])
def test_a_refused_link_hides_no_other(spark, block):
    """Of all links within the bits only some are confirmed; each of those counts."""
    base = random.Random(3).getrandbits(64)
    fps = [base ^ (1 << k) for k in range(24)]
    nodes = spark.createDataFrame([(k, 10, f) for k, f in enumerate(np.array(fps, np.uint64).view(np.int64).tolist())], "node long, size long, f0 long")
    true = {(5, 17), (9, 23), (17, 22), (1, 2)}

    def confirm(links):
        return links.where(" or ".join(f"(least(x, y) = {a} and greatest(x, y) = {b})" for a, b in true)).select("a", "b")

    got = {r["node"]: r["cluster"] for r in simhash.clusters(nodes, limit=4, block=block, confirm=confirm).collect()}
    assert got == {k: {17: 5, 22: 5, 23: 9, 2: 1}.get(k, k) for k in range(24)}


def test_one_wide_key_is_enough(spark):
    """Pairs that share a single key, which no third node has, are compared."""
    rng, fps = random.Random(12), []
    while len(fps) < 20:
        a = rng.getrandbits(64)
        b = a
        for p in rng.sample(range(64), 10):
            b ^= 1 << p
        x, y = (set(simhash.wide_keys(np.array([f], np.uint64))[1].tolist()) for f in (a, b))
        if len(x & y) == 1:
            fps += [a, b]
    nodes = spark.createDataFrame([(k, 100, f) for k, f in enumerate(np.array(fps, np.uint64).view(np.int64).tolist())], "node long, size long, f0 long")
    got = {r["node"]: r["cluster"] for r in simhash.clusters(nodes, limit=12, wide=True).collect()}
    assert got == {k: k - k % 2 for k in range(20)}


@pytest.mark.parametrize("edit", ["replace", "append", "delete", "insert"])
def test_recall_by_similarity_and_edit(spark, edit):
    """Of pairs in each band of similarity from 0.8 on nine in ten are found at least; none below."""
    rng, rows, bands = random.Random(edit), [], {}
    for k in range(240):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(150, 400))]
        n = len(w) * rng.randint(1, 22) // 100 + 1
        new = [f"x{rng.randint(0, 10**6)}" for _ in range(n)]
        at = rng.randint(1, len(w) - n)
        c = {"replace": w[:at] + new[: n // 2 + 1] + w[at + n // 2 + 1 :], "append": w + new, "delete": w[:-n], "insert": w[:at] + new + w[at:]}[edit]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(c))]
        bands.setdefault(int(jaccard(rows[-2][1], rows[-1][1]) * 20 + 1e-9), []).append(2 * k + 1)
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for band, ids in bands.items():
        gone = sum(i not in kept for i in ids)
        assert gone >= 0.9 * len(ids) if band >= 16 else not gone, (band / 20, gone, len(ids))


def test_bins_with_many_keys_are_dealt_over_tasks(spark, monkeypatch):
    """Buckets that are split over tasks and blocks lose no link: the same clusters come out."""
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)})
    nodes = spark.createDataFrame([(k, f) for k, f in enumerate(np.array(fps, np.uint64).view(np.int64).tolist())], "node long, f0 long").cache()
    plain_ = {r["node"]: r["cluster"] for r in simhash.clusters(nodes).collect()}
    up = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and up[i] != up[j]:
                low, high = sorted((up[i], up[j]))
                up = [low if u == high else u for u in up]
    assert plain_ == dict(enumerate(up))
    monkeypatch.setattr(simhash, "_shares", lambda *a: (np.full(simhash.BINS, 3), 100_000))
    assert {r["node"]: r["cluster"] for r in simhash.clusters(nodes, block=40).collect()} == plain_


def test_parities_never_say_more_than_the_sets():
    rng = np.random.default_rng(4)
    for n in (0, 1, 30, 400, 5000):
        a = rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
        for away in (0, 1, n // 10, n):
            b = np.concatenate([a[away:], rng.integers(0, 2**63, away, dtype=np.int64).view(np.uint64)])
            apart = np.bitwise_count(simhash.parities(np.unique(a)) ^ simhash.parities(np.unique(b))).sum()
            assert apart <= len(np.setxor1d(a, b))
            assert away or not apart


def test_a_dense_group_of_short_copies_around_the_limit(spark):
    """Short texts of one base, many just below the similarity: the same groups as by comparing all pairs."""
    rng = random.Random(13)
    base = [f"w{k}" for k in range(45)]
    rows = []
    for k in range(150):
        w = [*base]
        for p in rng.sample(range(45), rng.randint(0, 2)):
            w[p] = f"v{rng.randint(0, 3)}"
        rows.append((k, " ".join(w)))
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if up[i] != up[j] and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                low, high = sorted((up[i], up[j]))
                up = [low if u == high else u for u in up]
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 1 < len(set(up)) < 140 and kept >= set(up)  # no two groups are joined
    assert len(kept) <= len(set(up)) + 0.1 * (len(rows) - len(set(up)))


def test_copies_around_the_limit_make_few_rows(spark, monkeypatch):
    """A large group of near copies: rows of pairs stay a few for each text, and the groups are those of all pairs."""
    rng, rows, met, real = random.Random(14), [], [], simhash.table
    for k in range(400):
        w = [f"w{p}" for p in range(150)]
        for p in rng.sample(range(150), rng.randint(1, 9)):
            w[p] = f"v{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(w)))

    def table(df, name, **options):
        out = real(df, name, **options)
        if name == "met":
            met.append(out.where("name is null").select("a", "b").distinct().count())
        return out

    monkeypatch.setattr(simhash, "table", table)
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[p : p + 5]) for p in range(146)} for _, t in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if up[i] != up[j] and same >= 0.8 * (len(sets[i]) + len(sets[j]) - same):
                low, high = sorted((up[i], up[j]))
                up = [low if u == high else u for u in up]
    assert kept >= set(up) and len(kept) <= len(set(up)) + 0.1 * (len(rows) - len(set(up)))
    assert sum(met) <= 20 * len(rows), met
