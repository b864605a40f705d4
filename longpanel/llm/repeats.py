"""Stretches of text around anchors, and what both substring deduplicators do with them.

A window is a run of ``length`` units (bytes or words) of one document. Of the runs of ``gram`` units in it, the one of
smallest hash (the leftmost of equals) is its anchor: equal windows have equal anchors at the same place, so windows
that repeat meet under one anchor hash. The windows of one anchor start next to each other; the units that they span
are its stretch, and every window lies in exactly one stretch.

1. Anchor hashes are counted; those seen once cannot hold a repeated window.
2. The stretches of the others are written out. Stretches that are alike are one row with the number and the first of
   their places: hot passages and copies meet in map-side sums, not in one task.
3. Anchors whose stretches are all alike need no comparison: their windows all repeat. The others go, with all
   stretches of their anchor, to the kernel of the operator. An anchor with more than ``BLOCK`` different stretches is
   dealt into blocks, and every pair of blocks is compared.
4. What the kernel finds is joined to the places, and the spans of each document to its text.

Rows are told apart by their file and their place in it (``rows.with_row``); nothing depends on keys being unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import keys_side, whole_groups
from .rows import with_row
from .scratch import partitions, stage
from .words import U, Hasher, _BYTES, batches, gram_hashes, mix, word_hashes

BLOCK = 4096
#: Stretches whose text a task remembers to have written.
SEEN = 500_000
#: Most repeated anchor hashes that are broadcast; above it texts are joined with their own.
ANCHORS = 8_000_000
#: Bytes of text that are cut together: their arrays stay in a core's cache.
BATCH = 200_000
_HASH = Hasher()


class Unit(NamedTuple):
    """How texts are cut: ``words`` or bytes, the length of a window, and of an anchor's run."""

    words: bool
    length: int
    gram: int


class Cut(NamedTuple):
    """Units of a batch: first byte and end of each, first unit of each row (one more at the end), gram hashes."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    grams: np.ndarray
    buf: np.ndarray


def cut(raw: list[bytes], unit: Unit) -> Cut:
    if unit.words:
        words, row, start, end, buf = word_hashes(raw)
        return Cut(start, end, np.searchsorted(row, np.arange(len(raw) + 1)), gram_hashes(words, unit.gram), buf)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    first = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
    place = np.arange(len(buf) + 1)
    return Cut(place[:-1], place[1:], first, _HASH.runs(_BYTES[buf], unit.gram), buf)


def anchors(c: Cut, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first unit and number of windows of each stretch of a batch (below 2**24 units)."""
    g, w = c.grams, unit.length - unit.gram + 1
    empty = np.empty(0, np.int64)
    n = len(g) - w + 1
    if n <= 0:
        return np.empty(0, np.uint64), empty, empty, empty
    bits = U((1 << 24) - 1)
    key = np.full((len(g) + w - 1) // w * w, ~U(0))
    np.bitwise_and(g, ~bits, out=key[:len(g)])
    key[:len(g)] |= np.arange(len(g), dtype=np.uint64)
    block = key.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(back[:n], ahead[w - 1:w - 1 + n])
    # a stretch ends where the anchor changes, and with its row
    new = np.ones(n, bool)
    np.not_equal(best[1:], best[:-1], out=new[1:])
    new[c.first[c.first < n]] = True
    lo = np.flatnonzero(new)
    row = np.searchsorted(c.first, lo, side="right") - 1
    # windows lie within a row: those that run over its end are its last ones
    size = np.minimum(np.append(lo[1:], n), c.first[row + 1] - unit.length + 1) - lo
    keep = size > 0
    lo, row, size = lo[keep], row[keep], size[keep]
    return mix(g[(best[lo] & bits).astype(np.int64)]), row, lo, size


def _texts(frame: pd.DataFrame, limit: int = BATCH) -> Iterator[tuple[int, list[bytes]]]:
    """Batches of a frame's texts as bytes, with the number of the first; a text beyond 2**24 units is cut by callers."""
    raw = [t.encode() if isinstance(t, str) else b"" for t in frame["text"]]
    for a, b in batches([len(t) for t in raw], limit):
        yield a, raw[a:b]


#: Texts beyond this many bytes are anchored piece by piece; pieces overlap by a window less one unit.
_PIECE = 8_000_000


def _pieces(raw: list[bytes], unit: Unit) -> Iterator[tuple[list[bytes], int, int]]:
    """(texts, unit at which they begin, bytes before them): one batch, or the pieces of one long text."""
    if len(raw) != 1 or len(raw[0]) <= _PIECE:
        yield raw, 0, 0
        return
    whole = cut(raw, Unit(unit.words, unit.length, 1))
    for lo in range(0, len(whole.start), _PIECE // 2):
        hi = min(len(whole.start), lo + _PIECE // 2 + unit.length - 1)
        yield [raw[0][whole.start[lo]:whole.end[hi - 1]]], lo, int(whole.start[lo])


def repeated_anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """``h``: hashes that anchor two or more stretches."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for frame in frames:
            for _, raw in _texts(frame):
                for part, _, _ in _pieces(raw, unit):
                    held.append(anchors(cut(part, unit), unit)[0])
            if sum(map(len, held)) > 500_000:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                held = []
                yield pd.DataFrame({"h": h.astype(np.int64), "n": np.minimum(n, 2).astype(np.int32)})
        if held:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            yield pd.DataFrame({"h": h.astype(np.int64), "n": np.minimum(n, 2).astype(np.int32)})

    t = docs.select("text").mapInPandas(count, "h long, n int")
    # hashes are nearly all different here: summing them before the exchange would only cost
    return stage(t.repartition(partitions(docs), "h").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "anchors")


def stretches(docs: DataFrame, unit: Unit) -> DataFrame:
    """``h``, ``s`` (hash of the stretch), ``row``, ``key``, ``lo`` (first unit), ``n`` (windows), ``body`` (once a task)."""
    wanted = repeated_anchors(docs, unit)
    schema = "h long, s long, row long, key long, lo long, n int, body binary"
    spark = docs.sparkSession
    shared = None
    t = docs.select("row", "key", "text")
    if wanted.count() <= ANCHORS:
        shared = spark.sparkContext.broadcast(np.sort(wanted.toArrow()["h"].to_numpy()))

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value if shared is not None else None
        seen: set[int] = set()
        for frame in frames:
            keys, rows, made = frame["key"].to_numpy(), frame["row"].to_numpy(), []
            for a, raw in _texts(frame):
                for part, skip, _ in _pieces(raw, unit):
                    c = cut(part, unit)
                    h, row, lo, n = anchors(c, unit)
                    h = h.astype(np.int64)
                    if known is not None:
                        keep = _among(h, known)
                        h, row, lo, n = h[keep], row[keep], lo[keep], n[keep]
                    if not len(h):
                        continue
                    x, y = c.start[lo], c.end[lo + n + unit.length - 2]
                    s = _stretch_hash(c, x, y, lo, n, unit).astype(np.int64)
                    body = np.full(len(h), None, object)
                    data = c.buf.tobytes()
                    # a stretch holds its anchor: its own hash tells it apart
                    for i, z in enumerate(s.tolist()):
                        if z not in seen:
                            seen.add(z)
                            body[i] = b" ".join(data[x[i]:y[i]].split()) if unit.words else data[x[i]:y[i]]
                    if len(seen) > SEEN:
                        seen.clear()
                    made.append((h, s, rows[a + row], keys[a + row], lo - c.first[row] + skip, n.astype(np.int32), body))
            if made:
                yield pd.DataFrame(dict(zip(("h", "s", "row", "key", "lo", "n", "body"), map(np.concatenate, zip(*made)))))

    out = t.mapInPandas(emit, schema)
    if shared is None:
        out = out.join(wanted.hint("merge"), "h")
    return stage(out, "stretches")


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places in ``h`` of values that the sorted ``known`` holds; looked up in order, which walks ``known`` once."""
    if not len(known):
        return np.empty(0, np.int64)
    order = np.argsort(h)
    sorted_h = h[order]
    found = known[np.minimum(np.searchsorted(known, sorted_h), len(known) - 1)] == sorted_h
    return np.sort(order[found])


def _stretch_hash(c: Cut, x: np.ndarray, y: np.ndarray, lo: np.ndarray, n: np.ndarray, unit: Unit) -> np.ndarray:
    """Hash of the units of each stretch, whatever stands between its words."""
    if not unit.words:
        return _HASH.slices(_BYTES[c.buf], x, y)
    words = _HASH.slices(_BYTES[c.buf], c.start, c.end)
    return _HASH.slices(words, lo, lo + n + unit.length - 1)


Kernel = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[list[list[int]], list[list[int]]]]


def spans(docs: DataFrame, unit: Unit, kernel: Kernel, keep_first: bool) -> DataFrame:
    """``row`` and ``spans``, the units to remove as (start, end) pairs, of every document that has some.

    With ``keep_first`` the first place of a repeated window is not removed.
    ``kernel(bodies, windows, counts, first keys, first places)`` gets the different stretches of some anchors and gives,
    for each, the ranges of windows to remove at all its places, and at all but its first place.
    """
    t = stretches(docs, unit)
    u = stage(t.groupBy("h", "s").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "row", "lo")).alias("first"),
                                      F.max("n").alias("n"), F.max("body").alias("body")), "unlike")
    sizes = u.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    many = stage(sizes.where("size > 1"), "compared")
    none, every = F.array().cast("array<int>"), F.array(F.lit(0), F.col("n") - 1)
    alike = (u.where("c > 1").join(keys_side(many.select("h")), "h", "left_anti")
             .select("h", "s", "first", (none if keep_first else every).alias("always"), (every if keep_first else none).alias("later")))
    more = u.join(keys_side(many), "h")
    m = F.ceil(F.col("size") / BLOCK).cast("int")
    more = more.withColumn("_m", m).withColumn("_own", F.pmod(F.xxhash64("s"), F.col("_m")).cast("int"))
    more = more.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    more = more.select("h", "s", "c", F.col("first.key").alias("key"), F.col("first.row").alias("row"), F.col("first.lo").alias("lo"), "n", "body",
                       F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
    by = ["h", "i", "j"]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, by):
            # one shard after another: several anchors together, each whole
            k = frame[by].to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(1), [True])))
            length = np.concatenate(([0], np.cumsum([len(b) for b in frame["body"]])))
            # a stretch stands in several pairs of blocks: such a pair is compared by itself
            size = np.where((k[edge[:-1], 1] > 0) | (k[edge[:-1], 2] > 0), 1 << 40, np.diff(length[edge]))
            for a, b in batches(size.tolist(), 200_000):
                part = frame.iloc[edge[a]:edge[b]]
                # places are ordered by key, and by row where keys are equal
                key, row = part["key"].to_numpy(np.int64), part["row"].to_numpy(np.int64)
                order = np.lexsort((row, key))
                rank = np.empty(len(part), np.int64)
                rank[order] = np.concatenate(([0], np.cumsum((key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1]))))
                always, later = kernel(list(part["body"]), part["n"].to_numpy(np.int64), part["c"].to_numpy(np.int64), rank, part["lo"].to_numpy(np.int64))
                found = [i for i in range(len(part)) if always[i] or later[i]]
                if not found:
                    continue
                yield pd.DataFrame({"h": part["h"].to_numpy()[found], "s": part["s"].to_numpy()[found],
                                    "always": [always[i] for i in found], "later": [later[i] for i in found]})

    found = (more.repartition(partitions(docs), *by).sortWithinPartitions(*by)
             .mapInPandas(compare, "h long, s long, always array<int>, later array<int>"))
    firsts = u.select("h", "s", "first")
    found = found.join(firsts.hint("merge"), ["h", "s"]).select("h", "s", "first", "always", "later")
    found = stage(alike.unionByName(found), "found")
    # both sides grow with the input: merged at every size, hot stretches split by Spark
    places = t.select("h", "s", "row", "lo").join(found.hint("merge"), ["h", "s"])
    is_first = (F.col("row") == F.col("first.row")) & (F.col("lo") == F.col("first.lo"))
    ranges = F.concat("always", F.when(is_first, none).otherwise(F.col("later")))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("r") / 2 - 1).cast("int")), lambda i: F.struct(
        (F.col("lo") + F.col("r")[(2 * i).cast("int")]).alias("a"),
        (F.col("lo") + F.col("r")[(2 * i + 1).cast("int")] + unit.length).alias("b")))
    places = places.select("row", "lo", ranges.alias("r")).where(F.size("r") > 0)
    return places.select("row", F.inline(pairs)).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def merged(pairs) -> list[tuple[int, int]]:
    """Sorted (start, end) pairs joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def numbered(docs: DataFrame, key: str) -> DataFrame:
    """``row``, ``key`` (NULL first), ``own`` (as it was), ``text``; the row number does not depend on splits, so every pass gives it alike."""
    t = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(key).alias("own"), "text")
    return with_row(t, "row").select("row", "key", "own", "text")


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with their ``spans``; NULL where nothing is removed."""
    return docs.join(stage(found, "spans").hint("merge"), "row", "left")
