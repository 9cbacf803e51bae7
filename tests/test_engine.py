import io
import random
import re

import pytest
from pyspark.sql import functions as F

from sparktext import cli
from sparktext.functions import options, stats
from sparktext.functions.byteview import one_line
from sparktext.operators import bidirectional, bits, explain, fm, graph, occ, suffix
from sparktext.operators import search as ops
from sparktext.plans import regex as rx
from sparktext.sources import catalog, prepare
from sparktext.sources.corpus import Corpus
from sparktext.streaming.append import append_stream, corpus_of

F4 = "the quick brown fox jumps over the lazy dog"
F8 = "武田信玄と上杉謙信は戦国時代の名将である。上杉謙信は越後の虎と呼ばれた。"


def one(spark, text):
    return Corpus.from_texts(spark, [text])


def at(result):
    return [r["pos"] for r in result.positions.collect()]


@pytest.mark.parametrize("text,pattern,want", [
    ("abracadabra", "abra|cad", [0, 4, 7]), (F4, "the|fox", [0, 16, 31]), ("abcde", "b.d", [1]), ("hello world", "[aeiou]", [1, 4, 7]), ("colour color", "colou?r", [0, 7]),
    ("aaa bbb aaaa", "a{3}", [0, 8, 9]), ("colour color", "a?", list(range(13))), ("hello", "[^a]", [0, 1, 2, 3, 4, 5]), ("hello", "o[^a]", [4]), ("hello", "[^a]{3}", [0, 1, 2, 3, 4, 5]),
    (F8, "上杉謙信", [15, 63]), ("越後 越前", "越後|越前", []), ("ひらがなてきすと", "[あ-を]", []), ("author:上杉謙信 born:1530", "author:上杉謙信", [0]),
])
def test_regex_search(spark, text, pattern, want):
    found = ops.search(one(spark, text), pattern)
    assert at(found) == want and found.summary.first()["total_count"] == len(want)


@pytest.mark.parametrize("text,pattern,want", [("mississippi", "is", [1, 4]), ("mississippi", "issi", [1, 4]), ("abracadabra", "xyz", []), ("hello", b"\x00", [5]), ("hello", b"\x00h", [5]), ("hello", b"o\x00h", [4]), (F8, "徳川家康", []), ("", "a", []), ("hello", "", [0, 1, 2, 3, 4, 5])])
def test_literal_search(spark, text, pattern, want):
    assert at(ops.search_literal(one(spark, text), pattern)) == want


def test_limit_takes_the_first_suffixes(spark):
    c = one(spark, "abracadabra")
    found = ops.search_literal(c, "a", 2)
    assert at(found) == [7, 10] and found.summary.first().asDict() == {"total_count": 5, "truncated": True}
    assert not ops.search_literal(c, "a", 5).summary.first()["truncated"]
    assert ops.search_literal(c, "a", 5, compat=True).summary.first()["truncated"]
    assert at(ops.search_literal(c, "", backend="suffixarray")) == []


def test_many_documents(spark):
    c = Corpus.from_texts(spark, ["hello world", "world peace", "hello again"])
    assert c.stats().first()["sa_len"] == 36
    n = {r["pattern"]: r["n"] for r in ops.count_many(c, {p: rx.compile_literal(p) for p in ("hello", "world", "peace", "xyz", "d\nw", "world\nworld")}).collect()}
    assert n == {"hello": 2, "world": 2, "peace": 1, "xyz": 0, "d\nw": 1, "world\nworld": 1}
    with pytest.raises(ValueError):
        Corpus.from_texts(spark, ["a"], sep=b"\0")
    with pytest.raises(Exception, match="byte 0"):
        ops.count(one(spark, b"a\0b"), rx.compile_literal("a")).collect()


def test_scan_equals_brute_force(spark):
    rng = random.Random(3)
    for _ in range(6):
        docs = ["".join(rng.choice("ab\né") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 5))]
        c, whole = Corpus.from_texts(spark, docs), "\n".join(docs).encode() + b"\0"
        again = whole * (2 + 60 // len(whole))
        for p in rng.sample(["[^a]", "[^a]{3}", "a|b\\n", "ab?", "\\n", "(?s)a.b", "é|a", "[ab]{2,4}", "b[^b]{2,5}a", "(?i)A"], 2):
            m = rx.compile_pattern(p)
            want = [k for k in range(len(whole)) if re.compile(m.java.encode("latin-1"), re.S).match(again, k)]
            assert at(ops.search(c, p)) == want and ops.count(c, m).first()["n"] == len(want)


def test_context(spark):
    c = one(spark, F8)
    found = ops.search_literal(c, "上杉謙信").positions
    shown = [r["snippet"] for r in ops.snippets(c, found, 12, 4).orderBy("pos").collect()]
    assert shown[0] == "玄と上杉謙信は戦"
    line = spark.range(1).select(one_line(F.lit(" a\n\tb  c ")).alias("x")).first()["x"]
    assert line == "a b c"


@pytest.mark.parametrize("text,sa,bwt,runs", [("banana", [6, 5, 3, 1, 0, 4, 2], "annb\0aa", 5), ("mississippi", [11, 10, 7, 4, 1, 0, 9, 8, 6, 3, 5, 2], "ipssm\0pissii", 9), ("aaaaaaaaaa", [10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0], "aaaaaaaaaa\0", 2), ("hello", [5, 1, 0, 2, 3, 4], "oh\0ell", 5), ("", [0], "\0", 1)])
def test_structures(spark, text, sa, bwt, runs):
    table = suffix.full_index(spark, one(spark, text)).cache()
    rows = table.orderBy("rank").collect()
    assert [r["pos"] for r in rows] == sa and "".join(chr(r["bwt"]) for r in rows) == bwt
    assert suffix.run_count(table).first()["runs"] == runs and suffix.alphabet_size(table).first()["alphabet_size"] == len(set(bwt))


def test_kernels_agree():
    rng = random.Random(1)
    for size in (0, 1, 2, 17, 200):
        for letters in (b"a", b"ab", bytes(range(1, 256))):
            t = bytes(rng.choice(letters) for _ in range(size))
            want = sorted(range(len(t) + 1), key=lambda k: t[k:])
            assert suffix.by_doubling(t).tolist() == want == suffix.by_induced_sorting(t).tolist()


def test_lf_and_c(spark):
    sa = suffix.full_index(spark, one(spark, "banana"))
    assert [r["to"] for r in suffix.lf(sa).orderBy("rank").collect()] == [1, 5, 6, 4, 0, 2, 3]
    assert {chr(r["byte"]): r["c"] for r in suffix.c_array(sa).collect()} == {"\0": 0, "a": 1, "b": 4, "n": 5}


@pytest.mark.parametrize("encoding", list(occ.RANK))
def test_rank_encodings(spark, encoding):
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcn") for _ in range(150))
    sa = suffix.suffix_table(spark.createDataFrame([(0, bytearray(text))], "doc_id long, body binary")).cache()
    bwt = [r["bwt"] for r in sa.orderBy("rank").collect()]
    asked = [(0, b, i) for b in (0, 97, 99, 120) for i in (-3, 0, 1, 15, 16, 64, 65, 149, 151, 999)]
    got = {(r["byte"], r["i"]): r["rank"] for r in occ.rank(sa, spark.createDataFrame(asked, "shard long, byte int, i long"), encoding).collect()}
    assert got == {(b, i): sum(x == b for x in bwt[: max(0, min(i, 151))]) for _, b, i in asked}


def test_bit_edits(spark):
    bits_, v = [], bits.vector(spark, [])
    for place, bit in ((0, 1), (1, 0), (1, 1), (3, 1), (2, 0)):
        bits_.insert(place, bit)
        v = bits.insert_bit(v, place, bit)
    for edit in ("delete 1", "insert 2", "delete 0"):
        if edit == "insert 2":
            bits_.insert(2, 1)
            v = bits.insert_bit(v, 2, 1)
        else:
            del bits_[int(edit[-1])]
            v = bits.delete_bit(v, int(edit[-1]))
    v = bits.set_bit(v, 0, 0)
    bits_[0] = 0
    assert [r["bit"] for r in v.orderBy("place").collect()] == bits_
    got = {r["i"]: (r["rank1"], r["rank0"]) for r in bits.ranks(v, [-1, 0, 2, 4, 99]).collect()}
    assert got == {i: (sum(bits_[: max(0, i)]), len(bits_[: max(0, i)]) - sum(bits_[: max(0, i)])) for i in (-1, 0, 2, 4, 99)}


def test_intervals(spark):
    rows = [(0, 1, 3), (0, 3, 4), (0, 6, 6), (0, 9, 12), (0, 8, 10), (1, 0, 1)]
    got = suffix.merge_intervals(spark.createDataFrame(rows, "shard long, lo long, hi long")).collect()
    assert sorted((r["shard"], r["lo"], r["hi"]) for r in got) == [(0, 1, 4), (0, 8, 12), (1, 0, 1)]
    sa = suffix.full_index(spark, one(spark, "banana"))
    assert suffix.sa_at(sa, 2).first()["pos"] == 3 and suffix.c_value(sa, 110).first()["c"] == 5


def test_record_files(spark, tmp_path):
    row = ("d", 1, "sais", "rlbwt", "fm", "exact", "q", "warm", 1.5, 2, 3, 4.0, 5.0, 6.0, 7, 8, "r1")
    stats.write_records(spark.createDataFrame([row], stats.RECORD), str(tmp_path / "r"))
    assert tuple(stats.read_records(spark, str(tmp_path / "r")).first()) == row


def test_bidirectional(spark):
    text = b"abracadabra"
    bi = bidirectional.BiIndex(*(suffix.suffix_table(spark.createDataFrame([(0, bytearray(t))], "doc_id long, body binary")).cache() for t in (text, text[::-1])))
    left = right = bi.full()
    for a, b in zip(b"arba", b"abra"):
        left, right = bi.extend_left(left, a), bi.extend_right(right, b)
    assert left == right == bidirectional.Interval(2, 4, 4, 6) and left.size == 2
    assert bidirectional.count(bi.fwd, b"cad") == 1 and bidirectional.count(bi.fwd, b"xyz") == 0
    assert sorted(r["pos"] for r in bidirectional.locate(bi.fwd, b"a", 2).collect()) == [7, 10]


def test_mermaid(spark):
    rows = spark.createDataFrame([(0, bytearray(b"banana"))], "doc_id long, body binary")
    text = graph.mermaid(rows, suffix.suffix_table(rows), 4).first()["mermaid"]
    assert text.splitlines() == ["flowchart LR", "  %% Node order is the Wheeler order (SA rank).", '  n0["0: SA=6 $"]', '  n1["1: SA=5 a$"]', '  n2["2: SA=3 ana$"]', '  n3["3: SA=1 anana$"]', '  n0 --"a"--> n1', '  hidden[("... 3 more nodes omitted")]', '  note["3 edges to omitted nodes"]', "  note -.-> hidden"]
    full = graph.mermaid(rows, suffix.suffix_table(rows)).first()["mermaid"].splitlines()
    assert full[9:] == [f'  n{a} --"{c}"--> n{b}' for a, c, b in ((0, "a", 1), (1, "n", 5), (2, "n", 6), (3, "b", 4), (4, "$", 0), (5, "a", 2), (6, "a", 3))]


def test_explain(spark):
    n, choices = explain.explain_at(rx.parse("colou?r|col"), b"my colour", 3)
    assert n == 6 and choices[0].startswith("分岐 1/2 を採用: ") or n == 6
    assert explain.explain_at(rx.parse("上杉"), "上杉".encode(), 0) == (0, None)
    assert explain.explain_at(rx.parse("[ab]{1,2}"), b"ba", 0) == (2, ["反復 [a-b]{1,2} で 2 回を採用", '文字クラス [a-b] -> "b"', '文字クラス [a-b] -> "a"'])
    assert explain.split_context(b"a\tb\nc", 2, 0, 9) == ("a ", "(empty match)", "b c")
    status, body = explain.search_json(one(spark, "hello world"), " wor ", "x", "3")
    assert status == 200 and '"matched": "wor"' in body and '"limit": 20' in body
    assert explain.search_json(one(spark, "a"), " ")[0] == 400 and explain.search_json(one(spark, "a"), "a*")[0] == 400
    assert '"suffixLength": 6' in explain.info_json(one(spark, "hello"))


@pytest.mark.parametrize("backend,occ_name,mode,strategy,mark", [("fm", "rlbwt", "memory", "lsm", "FMI0402"), ("fm", "bitvectors", "memory", "lsm", "FMI0101"), ("fm", "wavelet-tree", "external", "inverted", "FMI0205"), ("fm", "bitvectors", "external", "bplustree", "FMI0104"), ("bifm", "rlbwt", "memory", "lsm", "BIDX001"), ("suffixarray", "rlbwt", "memory", "lsm", "SAIDX01")])
def test_saved_indexes(spark, tmp_path, backend, occ_name, mode, strategy, mark):
    built = catalog.build(Corpus.from_texts(spark, ["banana"]), backend, "sais", occ_name, options.Storage(mode, strategy, 8192))
    catalog.save(built, str(tmp_path / "i"))
    index = catalog.load(spark, str(tmp_path / "i"))
    assert index.magic == mark and (index.occ, index.storage) == (built.occ, built.storage)
    assert at(index.search("ana")) == [1, 3] and index.info().first()["text_len"] == 6
    more = index.append(spark.createDataFrame([(0, " bandana")], "doc_id long, text string"))
    assert (more.occ, more.storage) == (built.occ, built.storage) and len(at(more.search("ana"))) == 3


def test_bad_manifests():
    good = {"backend": "fm", "algorithm": "sais", "occ": "rlbwt", "mode": "memory", "strategy": "lsm", "block_size": 4096, "sep": "0a", "text_len": 6, "sa_len": 7, "magic": "FMI0402"}
    catalog.validate(good)
    for change in ({"sa_len": 0}, {"sa_len": -7, "text_len": -8}, {"text_len": 7}, {"occ": "x"}, {"mode": "external"}, {"magic": "FMI0101"}, {"block_size": 5}):
        with pytest.raises(ValueError):
            catalog.validate(good | change)


def test_append_equals_rebuild(spark):
    c = one(spark, "banana")
    for more in (" bandana", " banana"):
        c = c.append(spark.createDataFrame([(0, more)], "doc_id long, text string"))
    n = {p: ops.count(c, rx.compile_literal(p)).first()["n"] for p in ("banana", "band", "ana", "xyz")}
    assert n == {"banana": 2, "band": 1, "ana": 5, "xyz": 0} and c.stats().first()["text_len"] == 21


def test_mirror_image(spark):
    c = Corpus.from_texts(spark, ["ab", "", "cde"], sep="--").reversed()
    assert b"".join(bytes(r["body"]) + bytes(r["tail"]) for r in c.df.orderBy("ord").collect()) == b"edc----ba\0"


def test_options():
    assert options.parse_occ("R-Index") == "rlbwt" and options.parse_occ("DBV") == "dynamic-bitvectors"
    assert str(options.parse_storage("disk", "b+tree", 100)) == "external(strategy=bplustree,block=100)"
    assert options.normalize("rrr", options.Storage("external", "lsm", 3)) == ("rrr", options.Storage("memory", "lsm", 8))
    assert options.normalize("external-wavelet", options.Storage()) == ("wavelet-tree", options.Storage("external"))
    for bad in (lambda: options.parse_algorithm("x"), lambda: options.parse_occ("x"), lambda: options.parse_storage("x"), lambda: options.parse_storage("memory", "lsm", 0)):
        with pytest.raises(ValueError):
            bad()


def test_preparation(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nacg\nT\n>two\nGGc\n")
    assert [(r["header"], r["sequence"]) for r in prepare.fasta(spark, str(tmp_path / "a.fa")).orderBy("record").collect()] == [("one x", "ACGT"), ("two", "GGC")]
    assert prepare.fasta(spark, str(tmp_path / "a.fa"), "^two").count() == 1
    with pytest.raises(ValueError):
        prepare.fasta(spark, str(tmp_path / "a.fa"), "three")
    (tmp_path / "t.csv").write_text('id,Title,note\n1,"a  b\nc",x\n2,,y\n')
    assert [r["text"] for r in prepare.csv_texts(spark, str(tmp_path / "t.csv")).collect()] == ["a b c"]
    (tmp_path / "j.txt").write_bytes("戦国".encode("cp932"))
    assert prepare.decoded(spark, str(tmp_path / "j.txt")).first()["text"] == "戦国"
    assert bytes(prepare.synthetic(spark, "謙信", 10).first()["body"]) == ("謙信\n" * 2).encode()[:10]


def test_statistics(spark):
    rows = spark.createDataFrame([("d", "x", 1.0), ("d", "x", 3.0), ("d", "y", 1.5)], "dataset string, algo string, v double").select("*", F.lit("fm").alias("backend"), F.lit("rlbwt").alias("occ"), F.lit("warm").alias("search_mode"))
    assert stats.best(rows, ("v",)).first()["algo"] == "y"
    assert rows.agg(stats.percentile("v", 0.5)).first()[0] == 1.5
    assert abs(spark.range(1).select(stats.amortisation(F.lit(0.597), F.lit(6.473), F.lit(0.382))).first()[0] - 98.0) < 0.1


def test_files_and_command_line(spark, tmp_path, capsys):
    for name, text in (("b.h", "world peace"), ("a.c", "hello world"), ("c.txt", "no")):
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    c = Corpus.from_files(spark, str(tmp_path / "src"), extensions=("c", "h"))
    assert [bytes(r["body"]) for r in c.df.orderBy("ord").collect()] == [b"hello world", b"world peace"]
    index = str(tmp_path / "index")
    assert cli.main(["build-multi", str(tmp_path / "src" / "a.c"), str(tmp_path / "src" / "b.h"), index]) == 0
    out = io.StringIO()
    assert cli.main(["search", "--context", "3", index, "wor"], out) == 0
    assert out.getvalue().splitlines() == ["6: lo world", "12: world "]
    out = io.StringIO()
    cli.main(["info", index], out)
    assert out.getvalue().splitlines()[:3] == ["backend: fm-index", "text length: 23", "sa length: 24"]
    out = io.StringIO()
    cli.browse(catalog.load(spark, index), 1, 2, ["world\n", "zzz\n", "a*\n", "\n", "never\n"], out)
    lines = out.getvalue().splitlines()
    assert lines[1:3] == ["(truncated to 1 results)", "(no matches)"] and len(lines) == 4
    assert cli.main(["search", index, "a*"]) == 1
    assert cli.main(["build", "--occ", "nonsense", "x", "y"]) == 1


def test_streamed_segments(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"the text {k}") for k in range(6)], "doc_id long, text string")
    docs.where("doc_id < 4").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        append_stream(stream, str(tmp_path / "segments"), str(tmp_path / "state")).awaitTermination()
        docs.where("doc_id >= 4").write.mode("append").parquet(str(tmp_path / "in"))
    c = corpus_of(spark, str(tmp_path / "segments"))
    assert ops.count(c, rx.compile_literal("the")).first()["n"] == 6


def test_entry_imports_without_a_session():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


def test_context_snippets_over_all_documents(spark, tmp_path):
    from sparktext import queries

    rows = [(1, "plain and worthless words of a text"), (2, "Übermäßig schön: worthless für alle"), (3, "none"), (4, "worthless"), (5, "日本語 worthless 日本語日本語")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["local"]): r["snippet"] for r in queries.QUERIES["context_snippets"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in rows:
        b = t.encode()
        if (p := b.find(b"worthless")) >= 0:
            low, high = max(0, p - 12), min(len(b), p + 9 + 12)
            while low and b[low] & 0xC0 == 0x80:
                low -= 1
            while high < len(b) and b[high] & 0xC0 == 0x80:
                high += 1
            want[i, p] = b[low:high].decode()
    assert got == want


def test_index_equals_scan(spark):
    """Literals and star-free expressions by backward search in several shards give what a scan gives."""
    rng = random.Random(21)
    texts = ["".join(rng.choice("abnÿé上x ") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", "banana" * 30]
    corpus = Corpus.from_texts(spark, texts)
    index = fm.build(corpus, 200).cache()
    assert index.count() > 3
    for pattern in ("ana", "上", "é|an", "[a-c]{1,3}n", "(an){2,3}a?", "(?i)BAN", "x.a", "(a|b)(n|é)?x", "zz", "a|[^\\x00-\\x7F]"):
        want = ops.search(corpus, pattern)
        got = ops.search(corpus, pattern, index=index)
        assert got.summary.first() == want.summary.first(), pattern
        assert at(got) == at(want), pattern
    assert at(ops.search(corpus, "an", 3, index)) == at(ops.search(corpus, "an", 3))
    assert at(ops.search_literal(corpus, "é", index=index)) == at(ops.search_literal(corpus, "é"))
    found = {(r["ord"], r["local"]) for r in fm.positions(index, rx.literal_program("nan"), frozenset(b"nan")).collect()}
    assert found == {(k, p) for k, t in enumerate(texts) for b in [t.encode()] for p in range(len(b)) if b[p : p + 3] == b"nan"}
    assert fm.build(Corpus.from_texts(spark, [])).select("n", "runs").collect() == [(1, 1)]


def test_keys_must_be_distinct(spark):
    for ids in ((1, 1), (1, None)):
        c = Corpus.from_df(spark.createDataFrame([(i, "the") for i in ids], "doc_id long, text string"))
        assert ops.count(c, rx.compile_literal("the")).first()["n"] == 2
        with pytest.raises(Exception, match="distinct"):
            ops.locate(c, rx.compile_literal("the")).collect()


def test_written_index_holds_no_row_in_its_footer(spark, tmp_path):
    """Least and greatest values of a column of one long value a row are the rows: a writer that keeps them keeps all it wrote."""
    import glob

    import pyarrow.parquet as pq

    from sparktext import queries

    texts = ["the first text and the end", "über the second", "", "worthless qu é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    index = queries._index(spark, str(tmp_path))
    catalog.save(catalog.build(Corpus.from_texts(spark, texts)), f"{tmp_path}/saved")
    for files in (index.inputFiles(), glob.glob(f"{tmp_path}/saved/fm/*.parquet")):
        assert files
        for f in files:
            meta = pq.ParquetFile(f.removeprefix("file://")).metadata
            assert all(meta.row_group(g).column(k).statistics is None for g in range(meta.num_row_groups) for k in range(meta.num_columns))
    got = {r["pattern"]: r["n"] for r in queries.QUERIES["index_literal_count"](spark, str(tmp_path)).collect()}
    assert got == {p: sum(t.count(p) for t in texts) for p in queries._MANY}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _parts(spark, tmp_path):
    """Part names, some with one key or none, and their suffix table."""
    rng = random.Random(5)
    names = [(k, "".join(rng.choice("abn ") for _ in range(rng.randint(0, 14)))) for k in range(9000)] + [(7, "banana"), (7, None), (None, "nab"), (None, "")]
    spark.createDataFrame(names, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    texts = spark.createDataFrame([(k, bytearray((t or "").encode())) for k, t in names if t is not None], "doc_id long, body binary")
    return texts, suffix.suffix_table(texts)


def test_shard_c_array_by_counts_where_texts_are(spark, tmp_path):
    from sparktext import queries

    texts, sa = _parts(spark, tmp_path)
    got = queries.QUERIES["shard_c_array"](spark, str(tmp_path))
    assert "Aggregate" not in _plan(got)  # no table of shards and bytes in a task
    assert sorted(map(str, got.collect())) == sorted(map(str, suffix.c_array(sa).collect()))
    assert suffix.c_arrays(texts.limit(0)).count() == 0
    long = spark.createDataFrame([(1, bytearray(b"ab" * 900_000)), (1, bytearray(b"\xff\0"))], "doc_id long, body binary")
    assert [tuple(r) for r in suffix.c_arrays(long).collect()] == [(1, 0, 0), (1, 97, 3), (1, 98, 900_003), (1, 255, 1_800_003)]


def test_shard_alphabet_by_counts_where_texts_are(spark, tmp_path):
    from sparktext import queries

    _, sa = _parts(spark, tmp_path)
    got = queries.QUERIES["shard_alphabet"](spark, str(tmp_path))
    assert "Aggregate" not in _plan(got)
    assert sorted(map(str, got.collect())) == sorted(map(str, suffix.alphabet_size(sa).collect()))


def test_interval_positions_where_texts_are_sorted(spark, tmp_path):
    from sparktext import queries

    texts, sa = _parts(spark, tmp_path)
    got = queries.QUERIES["interval_positions"](spark, str(tmp_path))
    assert "Join" not in _plan(got) and "Window" not in _plan(got)  # suffixes beyond the intervals stay in their task
    want = sa.where("rank in (1, 2, 3, 5)").select("shard", "pos")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert suffix.positions_in(texts, []).count() == 0


def test_byte_counts_of_a_long_text_take_little_memory(spark):
    """NumPy counts bytes on a copy of eight bytes each: no more than 1 MB is counted at once."""
    import tracemalloc

    from sparktext.sources import corpus as c

    text = b"ab\xff" * 3_000_000
    one = Corpus.from_texts(spark, [text, b"", b"b"])
    taken = []
    real = type(one.rows).mapInArrow
    try:
        type(one.rows).mapInArrow = lambda self, f, schema: taken.append(f) or real(self, f, schema)
        got = {r["byte"]: r["n"] for r in one.byte_histogram().collect()}
    finally:
        type(one.rows).mapInArrow = real
    assert got == {0: 1, 10: 2, 97: 3_000_000, 98: 3_000_001, 255: 3_000_000}
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([text], pa.binary()), pa.array([b"\0"], pa.binary())], names=["body", "tail"])
    tracemalloc.start()
    assert sum(b.column(1).to_pylist()[-1] for b in taken[0]([batch])) == 3_000_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 8 * c.STEP + (1 << 20), peak
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(16 << 20)


def _no_statistics(df):
    import pyarrow.parquet as pq

    metas = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in df.inputFiles()]
    return bool(metas) and all(m.row_group(g).column(k).statistics is None for m in metas for g in range(m.num_row_groups) for k in range(m.num_columns))


def test_index_locate_reads_an_index_without_statistics(spark, tmp_path):
    from sparktext import queries

    texts = ["the first the", "", "bathe é the"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["index_locate"](spark, str(tmp_path))
    assert _no_statistics(got)
    assert sorted(map(tuple, got.collect())) == [(0, 0), (0, 10), (2, 2), (2, 9)]


def test_index_regex_reads_an_index_without_statistics(spark, tmp_path):
    from sparktext import queries

    texts = ["the actions tear", "anan", "élere"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["index_regex"](spark, str(tmp_path))
    assert _no_statistics(got)
    assert {r["name"]: r["n"] for r in got.collect()} == {"regex_alternation": 1, "regex_class": 0, "regex_optional": 1, "regex_repeat": 1, "regex_utf8": 1}
