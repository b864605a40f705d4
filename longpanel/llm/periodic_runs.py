"""Runs of words that repeat with a period, found by dyadic square catching.

A run is a stretch of consecutive words with smallest period ``q`` whose length is at least ``max(24, 3 * q)`` and that no
neighbour extends keeping the period. Words are appended to a growing sequence. Of every power of two ``w`` there is a
grid of blocks; once the block that ends ``w`` words before a grid point is complete, it has a catcher, which watches the
suffixes that begin in it (their distances to the grid point are ``w`` to ``2w - 1``) while the next ``w`` words are
appended, and keeps the distances at which the appended words repeat the words before. A run of length ``3q`` has a grid
point of its own size at which its period is so caught. Comparisons advance by fingerprints: of the ``w`` words behind
a grid point, and of as many behind each start in the block; a whole append is one array operation per size. A distance
that is kept is followed back and on to the square's ends, by binary search over fingerprints and then word by word
to be sure, so squares of one run merge into one stretch. Distances that a known run explains are not followed again;
runs that reach the last word stay open and grow with the next append.

Texts of a batch are appended one after another with a word between them that is unlike any other, so nothing spans two
texts. Words are told apart by a dictionary of the batch, not by hashes. Memory follows the words of a batch: about 60
bytes a word; a text longer than a batch is a batch of its own and is cut into words in pieces, never held as a list.

NULL and empty texts have no words and no runs. Repeated rows are rows of their own, an empty table gives no rows. Only
the key and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import _powers, batches, mix

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BACK = U(pow(int(_BASE), -1, 2**64))
#: Smallest grid: its catchers also watch the distances below it.
SMALL = 8
SHORTEST, EXPONENT = 24, 3
#: Bytes of text cut into words at a time, and about the bytes of a batch.
PIECE, BATCH = 1 << 20, 2 << 20
_UNEVEN = re.compile(rb"[\t-\r]|  |\A | \Z")
RUN = "array<struct<start:long,length:long,period:long>>"


class Catchers:
    """Runs of a sequence of numbers that grows by ``append``; ``longest`` bounds the length of any of them."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.n = 0
        self.x = np.empty(0, np.int64)
        # total[i]: sum of mixed words before i, each times a power of the base; down[i]: that power's inverse
        self.total, self.down = np.zeros(1, np.uint64), np.ones(1, np.uint64)
        self.point: dict[int, int] = {}  # next grid point of each size whose catcher is not done
        self.runs: list[tuple[int, int, int]] = []  # (start, end, period), at least two periods long
        self.open: list[tuple[int, int]] = []  # (start, period) of those that reach the last word

    def _prints(self, first: int, last: int, w: int) -> np.ndarray:
        """Fingerprint of ``w`` words at each place in ``[first, last)``."""
        return (self.total[first + w:last + w] - self.total[first:last]) * self.down[first:last]

    def append(self, x: np.ndarray) -> None:
        old, n = self.n, self.n + len(x)
        up = _powers(_BASE, len(x)) * U(pow(int(_BASE), old, 2**64))
        sums = np.cumsum(mix(x.view(np.uint64) + U(1)) * up) + self.total[-1]
        self.x = np.concatenate((self.x, x))
        self.total = np.concatenate((self.total, sums))
        self.down = np.concatenate((self.down, _powers(_BACK, len(x)) * U(pow(int(_BACK), old + 1, 2**64))))
        self.n = n
        grown = self.open  # known runs grow first, so that they explain what follows
        for start, q in grown:
            self.runs.append((start, old + int(self._same_on(np.array([old]), np.array([q]))[0]), q))
        w = SMALL
        while EXPONENT * w <= max(self.longest, SHORTEST):
            self._catch(w)
            w *= 2
        self.open = [(s, q) for s, e, q in self.runs if e == n]
        self.runs = [r for r in self.runs if r[1] < n]

    def _catch(self, w: int) -> None:
        """Advance the catchers of the grid points of size ``w`` whose ``w`` words are now complete."""
        p0, p1 = self.point.get(w, w), self.n // w * w
        if p1 <= p0:
            return
        self.point[w] = p1
        points = np.arange(p0, p1, w)
        head = (self.total[points + w] - self.total[points]) * self.down[points]
        # reach[i]: from here to behind the point's words all is one known run, of a period that the words show whole
        reach = np.full(len(points), self.n, np.int64)
        for start, end, q in self.runs:
            a, b = max(0, -(-(start + 1 - p0) // w)), min(len(points), (end - w - p0) // w + 1)
            if a < b and q <= w:
                np.minimum(reach[a:b], start, out=reach[a:b])
        found = []
        if p0 == w and self._prints(0, 1, w)[0] == head[0]:  # the first point's block has one start
            found.append((np.array([w]), np.array([w])))
        # the block of starts at distances w to 2w - 1; for the smallest grid also those nearer
        for back in (2 * w, w) if w == SMALL else (2 * w,):
            skip = int(p0 < back)
            if skip >= len(points):
                continue
            lo = p0 - back + 1
            block = self._prints(lo + skip * w, lo + len(points) * w, w).reshape(-1, w)
            hit = block == head[skip:, None]
            if back == w:
                hit[:, w - 1] = False  # the point itself
            hit[1:] &= ~hit[:-1]  # the next point of one stretch
            i, j = np.nonzero(hit)
            at = points[i + skip]
            start = at - back + 1 + j
            keep = start < reach[i + skip]
            found.append((at[keep], at[keep] - start[keep]))
        if found:
            self._follow(*(np.concatenate(v) for v in zip(*found)))

    def _same_on(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words from ``at`` on equal those ``q`` before."""
        low, high = np.zeros(len(at), np.int64), self.n - at
        while (todo := low < high).any():
            mid = (low + high + 1) // 2
            same = self._slice(at, mid) == self._slice(at - q, mid)
            low, high = np.where(todo & same, mid, low), np.where(todo & ~same, mid - 1, high)
        return low

    def _same_back(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words before ``at`` equal those ``q`` before them."""
        low, high = np.zeros(len(at), np.int64), at - q
        while (todo := low < high).any():
            mid = (low + high + 1) // 2
            same = self._slice(at - mid, mid) == self._slice(at - q - mid, mid)
            low, high = np.where(todo & same, mid, low), np.where(todo & ~same, mid - 1, high)
        return low

    def _slice(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.total[at + size] - self.total[at]) * self.down[at]

    def _follow(self, at: np.ndarray, q: np.ndarray) -> None:
        """Squares through the kept distances, each stretch once."""
        if not len(at):
            return
        start, end = at - q - self._same_back(at, q), at + self._same_on(at, q)
        square = end - start >= 2 * q
        found = np.unique(np.stack((start[square], end[square], q[square]), axis=1), axis=0)
        last = None
        for s, e, p in found.tolist():
            if (s, e) == last:  # a multiple of the smallest period
                continue
            last = (s, e)
            x = self.x
            if not np.array_equal(x[s + p:e], x[s:e - p]):  # fingerprints that met by chance: word by word
                a = next(a for a in (at[(start == s) & (end == e) & (q == p)]).tolist())
                s, e = a - p, a
                while s > 0 and x[s - 1] == x[s - 1 + p]:
                    s -= 1
                while e < self.n and x[e] == x[e - p]:
                    e += 1
                if e - s < 2 * p:
                    continue
            self.runs.append((s, e, p))

    def close(self) -> np.ndarray:
        """Rows (start, end, period) of the runs, by start, then period."""
        found = sorted({*self.runs, *((s, self.n, q) for s, q in self.open)})
        out, last = [], None
        for s, e, q in found:
            if (s, e) != last and e - s >= max(SHORTEST, EXPONENT * q):
                out.append((s, e, q))
            last = (s, e)
        out.sort(key=lambda r: (r[0], r[2]))
        return np.array(out, np.int64).reshape(-1, 3)


class _Ids(dict):
    """Numbers of words, given as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, about ``PIECE`` bytes at a time; never cut inside a word."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            m = _SPACE.search(text, end)
            end = m.start() if m else len(text)
        yield text[at:end].split()
        at = end


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def text_runs(texts: list[bytes]) -> tuple[list[int], list[np.ndarray]]:
    """For each text the number of its words, and its runs as rows (start, end, period)."""
    ids, counts, parts = _Ids(), [], []
    for i, t in enumerate(texts):
        n = 0
        for words in _pieces(t):
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            n += len(words)
        parts.append(np.array([-2 - i]))
        counts.append(n)
    longest = max(counts, default=0)
    if longest < SHORTEST:
        return counts, [np.empty((0, 3), np.int64)] * len(texts)
    c = Catchers(longest)
    c.append(np.concatenate(parts))
    runs = c.close()
    first = np.cumsum([0, *(n + 1 for n in counts)])
    cut = np.searchsorted(runs[:, 0], first)
    return counts, [runs[a:b] - [[f, f, 0]] for a, b, f in zip(cut, cut[1:], first)]


def without(text: bytes, n: int, runs: np.ndarray) -> bytes:
    """The words that no run repeats, joined by single spaces."""
    if not len(runs):
        return b" ".join(b" ".join(ws) for ws in _pieces(text) if ws) if _UNEVEN.search(text) else text
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(runs[:, 0] + runs[:, 2], n), 1)
    np.add.at(edge, runs[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    out, at = [], 0
    for ws in _pieces(text):
        part = keep[at:at + len(ws)]
        at += len(ws)
        if part.any():
            out.append(b" ".join(ws if part.all() else [w for w, k in zip(ws, part.tolist()) if k]))
    return b" ".join(out)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``n_words``, ``runs`` (by start, then period) and ``collapsed``, the text without repeats."""

    def scan(frames: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for frame in frames:
            sizes = frame.column("size").to_pylist()
            for a, b in batches(sizes, BATCH):
                few = frame.slice(a, b - a)
                texts = [t or b"" for t in few.column("text").to_pylist()]
                counts, runs = text_runs(texts)
                flat = np.concatenate([r for r in runs]) if runs else np.empty((0, 3), np.int64)
                struct = pa.StructArray.from_arrays([flat[:, 0].copy(), flat[:, 1] - flat[:, 0], flat[:, 2].copy()], fields=list(kind.value_type))
                offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [few.column("key"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), struct, type=kind),
                     pa.array([without(t, n, r) for t, n, r in zip(texts, counts, runs)], pa.binary())],
                    ["key", "n_words", "runs", "collapsed"])

    t = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"),
                    F.coalesce(F.octet_length(text), F.lit(0)).alias("size"))
    out = t.mapInArrow(scan, f"key {docs.schema[key].dataType.simpleString()}, n_words long, runs {RUN}, collapsed binary")
    return out.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def greatest(runs: Column) -> Column:
    """Of an array of runs that of greatest exact length / period; ties: smallest start, then period. NULL if none."""

    def better(best: Column, r: Column) -> Column:
        a, b = r["length"] * best["period"], best["length"] * r["period"]
        first = (r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"]))
        return F.when((a > b) | ((a == b) & first), r).otherwise(best)

    return F.when(F.size(runs) > 0, F.aggregate(runs, runs[0], better))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with a run laid into the tail of every tenth document, chosen by a hash of its ``doc_id``."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("w").cast("long"), F.expr("h div 10")
    a = F.when(n > 0, g % n)
    p = F.lit(1) + F.expr("(n - a) div (3 + g % 8)")
    t = docs.select("doc_id", "text", h.alias("h"), F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("w"))
    t = t.select("doc_id", "text", "w", "h", n.alias("n"), a.alias("a"), g.alias("g")).withColumn("p", p)
    # the words from a on are the p words there, again and again; the last time as far as they reach
    unit = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.expr("cast((n - a + p - 1) div p as int)"))), 1, (F.col("n") - F.col("a")).cast("int"))
    laid = F.array_join(F.concat(F.slice("w", 1, F.col("a").cast("int")), tail), " ")
    return t.select("doc_id", F.when(F.col("w").isNotNull() & (F.col("n") > 0), laid).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """Counts, the run of greatest exponent and checksums per document, after ``planted``."""
    t = find(planted(docs)).withColumn("best", greatest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return t.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
