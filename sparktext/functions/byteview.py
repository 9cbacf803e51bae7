"""The byte view: a string whose k-th character is the k-th byte of a text. On it, Java's regular
expressions, ``length`` and ``substring`` work on bytes, whatever the encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def view(body: str | Column) -> Column:
    """Byte view of a binary column."""
    return F.decode(body, "ISO-8859-1")


def unview(chars: str | Column) -> Column:
    """Bytes of a byte view."""
    return F.encode(chars, "ISO-8859-1")


def text(chars: str | Column) -> Column:
    """A byte view read as UTF-8."""
    return F.decode(unview(chars), "UTF-8")


def byte_at(chars: Column, k: Column) -> Column:
    """The k-th byte (from 0) as a number; 0 beyond the end."""
    return F.coalesce(F.ascii(F.substring(chars, k + 1, F.lit(1))), F.lit(0))


def _follows(chars: Column, k: Column) -> Column:
    b = byte_at(chars, k)
    return (b >= 128) & (b < 192)


def context(chars: Column, pos: Column, pat_len: int | Column, around: int) -> Column:
    """The text from ``around`` bytes before a match to as many after it, grown outward to whole
    characters. A position at the end of the text with nothing around gives an empty string."""
    n = F.length(chars)
    pat_len = F.lit(pat_len) if isinstance(pat_len, int) else pat_len
    lo, hi = F.greatest(pos - around, F.lit(0)), F.least(pos + pat_len + around, n)
    # a character has at most three continuing bytes: at most three steps each way
    for _ in range(3):
        lo = F.when((lo > 0) & (lo < n) & _follows(chars, lo), lo - 1).otherwise(lo)
    for _ in range(3):
        hi = F.when((hi < n) & _follows(chars, hi), hi + 1).otherwise(hi)
    return text(F.substring(chars, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")))


def one_line(snippet: str | Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(snippet, r"\s+", " "))


def suffix_preview(chars: Column, pos: Column, size: int) -> Column:
    """The suffix's first bytes and ``$`` for the sentinel after them."""
    return F.concat(text(F.substring(chars, (pos + 1).cast("int"), F.lit(size))), F.lit("$"))
