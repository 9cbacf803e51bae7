"""Backward search and bidirectional extension on suffix tables.

A step narrows an interval of ranks by one byte. Its counts are one aggregation over the transform's
rows (no rank structure is needed for a few steps); the driver loops over the pattern's bytes, of which
there are few, and keeps four integers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    """Ranks [lo, hi) in the index of the text, and of the reversed text."""

    lo: int
    hi: int
    rev_lo: int
    rev_hi: int

    @property
    def size(self) -> int:
        return max(0, self.hi - self.lo)


def step(sa: DataFrame, byte: int, lo: int, hi: int) -> tuple[int, int]:
    """Ranks of suffixes that start with ``byte`` before those of [lo, hi)."""
    b, r = F.col("bwt"), F.col("rank")
    n = lambda cond: F.coalesce(F.count_if(cond), F.lit(0))
    c, x, y = sa.agg(n(b < byte), n((b == byte) & (r < lo)), n((b == byte) & (r < hi))).first()
    return c + x, c + y


def backward_search(sa: DataFrame, pattern: bytes) -> list[tuple[int, int]]:
    """The interval after each byte, from the last one on; ends when it is empty. The empty pattern
    gives the interval of all suffixes."""
    lo, hi = 0, sa.count()
    trace = [] if pattern else [(lo, hi)]
    for byte in reversed(pattern):
        lo, hi = step(sa, byte, lo, hi)
        trace.append((lo, hi))
        if lo >= hi:
            break
    return trace


def count(sa: DataFrame, pattern: bytes) -> int:
    lo, hi = backward_search(sa, pattern)[-1]
    return max(0, hi - lo)


def locate(sa: DataFrame, pattern: bytes, limit: int = 0) -> DataFrame:
    """pos of the first ``limit`` suffixes of the interval (all for 0 or less)."""
    lo, hi = backward_search(sa, pattern)[-1]
    hi = min(hi, lo + limit) if limit > 0 else hi
    return sa.where((F.col("rank") >= lo) & (F.col("rank") < hi)).select("pos")


class BiIndex:
    """Suffix tables of a text and of its mirror image, for extension on both sides."""

    def __init__(self, fwd: DataFrame, rev: DataFrame):
        self.fwd, self.rev = fwd, rev

    def full(self) -> Interval:
        n = self.fwd.count()
        return Interval(0, n, 0, n)

    @staticmethod
    def _extend(sa: DataFrame, byte: int, lo: int, hi: int, other: int) -> tuple[int, int, int, int]:
        b, r = F.col("bwt"), F.col("rank")
        within = (r >= lo) & (r < hi)
        c, x, y, less = sa.agg(F.count_if(b < byte), F.count_if((b == byte) & (r < lo)), F.count_if((b == byte) & (r < hi)), F.count_if(within & (b < byte))).first()
        new_lo, new_hi = c + x, c + y
        if new_lo >= new_hi:
            return new_lo, new_lo, other, other
        return new_lo, new_hi, other + less, other + less + new_hi - new_lo

    def extend_left(self, iv: Interval, byte: int) -> Interval:
        """The interval of byte + pattern."""
        return Interval(*self._extend(self.fwd, byte, iv.lo, iv.hi, iv.rev_lo))

    def extend_right(self, iv: Interval, byte: int) -> Interval:
        """The interval of pattern + byte."""
        lo, hi, a, b = self._extend(self.rev, byte, iv.rev_lo, iv.rev_hi, iv.lo)
        return Interval(a, b, lo, hi)
