import hashlib
import random

import numpy as np
import pytest

from sparktext.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(vocabulary.data.splitlines()), special_tokens={})


@pytest.mark.parametrize("max_states", [50, 5_000])
def test_equals_merges(vocabulary, reference, max_states):
    coder = bpe.ByteBPE(bpe.load_ranks(vocabulary.data.splitlines()), P.PATTERN, max_pieces=300)
    coder.fst.max_states = max_states
    rng = random.Random(1)
    letters = [chr(c) for c in (0x1C, 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0)] + list(" \t\n\r'sabtreé日本漢한😀अ१²_-!#") + ["  ", "the", "ing", "'ll"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 16))) for _ in range(5000)] + ["", "a" * 3000, " " * 500, "<|endoftext|>"]
    for t in texts:
        ids = np.frombuffer(coder.encode(t), "<u4")
        assert ids.tolist() == reference.encode_ordinary(t)
        assert b"".join(coder.decode(ids, 3)) == t.encode()


def test_utf8_machine_cuts_between_characters():
    data = "aé日😀".encode() * 5
    for size in range(1, 8):
        m = bpe.Utf8Machine()
        parts = [m.push(data[k : k + size]) for k in range(0, len(data), size)] + [m.finish()]
        assert b"".join(parts) == data and all(p.decode() is not None for p in parts)
    m = bpe.Utf8Machine()
    assert m.push(b"a\xe3\x81") == b"a" and m.push(b"b") == b"\xe3\x81b" and m.push(b"\xf5") == b"\xf5" and m.finish() == b""


def test_round_trip(odd, odd_rows, vocabulary, reference):
    got = {r["doc_id"]: r for r in bpe.round_trip(odd, vocabulary, with_ids=True).collect()}
    for i, t, *_ in odd_rows:
        ids = reference.encode_ordinary(t or "")
        r = got[i]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_then_decode(loose, empty, odd_rows, vocabulary):
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(loose, vocabulary), vocabulary).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in odd_rows)
    assert bpe.round_trip(empty, vocabulary).count() == 0
