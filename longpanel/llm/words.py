"""Words, as column expressions and as hashes computed over a whole batch of texts.

A word is a run of code points outside space and the control characters 09 to 0D (``[^\\x20\\x09-\\x0D]+``). All of
these are single bytes in UTF-8, so words can be cut on bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    """Words of a text in order; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without keeping them; NULL has none."""
    t = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(t, SPACES))
    edges = t.rlike(r"\A[\x20\x09-\x0D]").cast("int") + t.rlike(r"[\x20\x09-\x0D]\z").cast("int")
    return F.when(t == "", 0).otherwise(F.greatest(F.lit(0), parts - edges)).cast("long")


# ------------------------------------------------------------------ hashes of a batch

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15 | 1)
_INV = U(pow(int(_MULT), -1, 2**64))
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** (0 .. n-1)`` modulo 2**64."""
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        filled = 1
        while filled < n:
            more = min(filled, n - filled)
            out[filled:filled + more] = out[:more] * U(pow(int(base), filled, 2**64))
            filled += more
    return out


class Hasher:
    """Polynomial hashes modulo 2**64 of slices of an array of 64-bit symbols; tables grow with the longest array seen."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def slices(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = self.sums(symbols)
        return mix((total[end] - total[start]) * self.down[start])

    def runs(self, symbols: np.ndarray, n: int) -> np.ndarray:
        """Hashes, not spread by :func:`mix`, of every run of ``n`` symbols, by its first."""
        if len(symbols) < n:
            return np.empty(0, np.uint64)
        total = self.sums(symbols)
        out = total[n:] - total[:-n]
        out *= self.down[:len(out)]
        return out

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        """Running sums of symbols times powers; a difference times ``down`` at its start is a slice's hash, not spread."""
        n = len(symbols)
        if len(self.up) <= n:
            self.up, self.down = _powers(_MULT, n + 1), _powers(_INV, n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.multiply(symbols, self.up[:n], out=total[1:])
        np.cumsum(total[1:], out=total[1:])
        return total


_HASHER = Hasher()


def batches(sizes: Sequence[int], limit: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``limit``; a longer row stands alone."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            out.append((first, i))
            first, total = i, 0
        total += n
    if first < len(sizes):
        out.append((first, len(sizes)))
    return out


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first byte and end (within the joined buffer) of every word; and the buffer's bytes."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    row_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    row = np.searchsorted(row_end, start, side="right")
    return _HASHER.slices(_BYTES[buf], start, end), row, start, end, buf


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes, by its first word; runs across rows are the caller's to drop."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = words[:m].copy()
    for k in range(1, n):
        out = out * _MULT + words[k:k + m]
    return mix(out)
