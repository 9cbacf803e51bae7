"""How a match came about: the longest way a pattern matches at a place and the choices on that way,
and the search and info answers as JSON.

Tracing runs in Python on the matches that are shown, which the limit bounds. It follows the
unsimplified tree forward; literals beyond ASCII aren't traced, and a dot takes any byte.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import regex as rx
from ..sources.corpus import Corpus
from . import search as ops

#: Ways that are followed at once.
MAX_WAYS = 256


def _shown(byte: int) -> str:
    return rx.quoted(chr(byte) if 32 <= byte <= 126 else f"\\x{byte:02x}")


def _lower(b: int) -> int:
    return b + 32 if 65 <= b <= 90 else b


def ways(node: rx.Node, text: bytes, pos: int) -> list[tuple[int, tuple[str, ...]]]:
    """(end, choices) of the ways the node matches at ``pos``."""
    k = node.kind
    if k == rx.LITERAL:
        part = text[pos : pos + len(node.runes)]
        if len(part) < len(node.runes) or max(node.runes) > 127:
            return []
        same = all((_lower(a) == _lower(b)) if node.fold else a == b for a, b in zip(part, node.runes))
        return [(pos + len(part), ())] if same else []
    if k in (rx.CLASS, rx.ANY, rx.ANY_NOT_NL):
        if pos >= len(text):
            return []
        b = text[pos]
        if k == rx.CLASS:
            if not any(lo <= b <= hi for lo, hi in zip(node.runes[::2], node.runes[1::2])):
                return []
            return [(pos + 1, (f"文字クラス {node} -> {_shown(b)}",))]
        return [(pos + 1, ())] if k == rx.ANY or b != 10 else []
    if k == rx.CONCAT:
        now: list = [(pos, ())]
        for sub in node.subs:
            now = _onward(now, lambda at, sub=sub: ways(sub, text, at))
        return now
    if k == rx.ALTERNATE:
        n = len(node.subs)
        each = ((end, (f"分岐 {i}/{n} を採用: {sub}", *c)) for i, sub in enumerate(node.subs, 1) for end, c in ways(sub, text, pos))
        return list(itertools.islice(each, MAX_WAYS))
    if k == rx.QUEST:
        return [(pos, ("オプション ? を省略",)), *((end, ("オプション ? を採用", *c)) for end, c in ways(node.subs[0], text, pos))]
    if k == rx.REPEAT:
        out: list = []
        for times in range(max(node.low, node.high), node.low - 1, -1):
            now = [(pos, ())]
            for _ in range(times):
                now = _onward(now, lambda at: [w for w in ways(node.subs[0], text, at) if w[0] != at])
            out += ((end, (f"反復 {node} で {times} 回を採用", *c)) for end, c in now)
            if len(out) >= MAX_WAYS:
                return out[:MAX_WAYS]
        return out
    if k == rx.CAPTURE:
        return ways(node.subs[0], text, pos)
    return [] if k in (rx.STAR, rx.PLUS, rx.NO_MATCH) else [(pos, ())]


def _onward(now: list, onward) -> list:
    each = ((end, c + more) for at, c in now for end, more in onward(at))
    return list(itertools.islice(each, MAX_WAYS))


def explain_at(node: rx.Node, text: bytes, pos: int) -> tuple[int, list[str] | None]:
    """Length and choices of the longest way; the first of equals; (0, None) if none is traced."""
    found = ways(node, text, pos)
    if not found:
        return 0, None
    end, choices = max(found, key=lambda w: w[0])
    return max(0, end - pos), list(choices) or None


def split_context(text: bytes, pos: int, length: int, around: int) -> tuple[str, str, str]:
    """Text before, matched, after, line breaks and tabs as spaces; cut at bytes."""
    n = len(text)
    pos = min(max(pos, 0), n)
    length = min(max(length, 0), n - pos)
    flat = lambda b: b.decode("utf-8", "replace").translate({13: 32, 10: 32, 9: 32})
    return flat(text[max(0, pos - around) : pos]), flat(text[pos : pos + length]) or "(empty match)", flat(text[pos + length : pos + length + around])


def positive(raw: str | None, default: int) -> int:
    """A positive integer, else the default."""
    try:
        v = int(raw or "")
    except ValueError:
        return default
    return v if v > 0 else default


def explained(corpus: Corpus, pattern: str, limit: int = 20, around: int = 80) -> DataFrame:
    """position, match_len, before, matched, after, choices of the shown matches; within a document."""
    node = rx.parse(pattern)
    found = ops.search(corpus, pattern, limit).positions
    rows = found.join(corpus.df.select("ord", "body"), "ord").select("pos", "local", "body")

    @F.udf("struct<match_len:int,before:string,matched:string,after:string,choices:array<string>>", useArrow=False)
    def trace(body, local):
        text = bytes(body)
        n, choices = explain_at(node, text, local)
        return (n, *split_context(text, local, n, around), choices)

    return rows.select(F.col("pos").alias("position"), trace("body", "local").alias("x")).select("position", "x.*").orderBy("position")


def search_json(corpus: Corpus, q: str, limit: str | None = None, around: str | None = None, default_limit: int = 20, default_context: int = 80) -> tuple[int, str]:
    """(status, body) of a search request. The count is that of the returned matches."""
    q = q.strip()
    if not q:
        return 400, json.dumps({"error": "query parameter q is required"})
    n, ctx = positive(limit, default_limit), positive(around, default_context)
    try:
        total = ops.search(corpus, q, n)
    except ValueError as e:
        return 400, json.dumps({"error": str(e)}, ensure_ascii=False)
    matches = [{"position": r["position"], "snippet": r["before"] + r["matched"] + r["after"], "before": r["before"], "matched": r["matched"], "after": r["after"], "choices": r["choices"]} for r in explained(corpus, q, n, ctx).collect()]
    truncated = total.summary.first()["truncated"]
    return 200, json.dumps({"pattern": q, "totalCount": n if truncated else len(matches), "truncated": truncated, "limit": n, "context": ctx, "matches": matches}, ensure_ascii=False)


def info_json(corpus: Corpus, path: str = "", backend: str = "fm", limit: int = 20, context: int = 80, min_chars: int = 4) -> str:
    """Body of an info request; sizes of suffixes and alphabet are given for the fm backend only."""
    s = corpus.stats().first()
    fm = backend == "fm"
    alphabet = corpus.alphabet_size().first()["alphabet_size"] if fm else 0
    return json.dumps({"indexPath": path, "textLength": s["text_len"], "suffixLength": s["sa_len"] if fm else 0, "alphabetSize": alphabet, "defaultLimit": limit, "contextSize": context, "minInteractiveChars": min_chars})
