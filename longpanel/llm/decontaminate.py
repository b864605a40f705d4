"""Benchmark decontamination by greedy string tiling.

Words are lower-case runs of letters and digits (ASCII punctuation separates). A document and a benchmark item that
share a seed of ``SEED`` words are tiled: of all common runs of unmarked words, at least ``SEED`` long, the longest is
marked in both, again and again, until none is left. Runs of a length are found by running Karp-Rabin hashes; the length
falls as in Wise's RKR-GST. An item is found in a document when its tiles cover ``COVERAGE`` of its words, in whatever
order they stand.

Items are a stated query set held against all documents in blocks of at most ``BLOCK_WORDS`` words by hash (an item
longer than that is in a block with those of its hash): a block is what a task holds, and documents are read once for
each block; nothing of them is shuffled.

Documents with NULL or empty text match nothing; items with fewer than ``SEED`` words are not searched for, as so
short a run says nothing. Repeated items match each; repeated documents are judged alike; an empty side gives no match.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import releasing
from .words import _INV, _MULT, _powers, batches, gram_hashes, word_hashes

SEED = 4
COVERAGE = 0.5
BLOCK_WORDS = 2_000_000

_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    return text.lower().encode().translate(_PLAIN) if isinstance(text, str) else b""


class Items(NamedTuple):
    """A block of items: their words' hashes, and where each seed stands."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted
    item: np.ndarray
    place: np.ndarray


def index(ids: list, texts: list[str | None], seed: int = SEED) -> Items:
    keep, words, h, item, place = [], [], [], [], []
    for i, t in zip(ids, texts):
        w = word_hashes([plain(t)])[0]
        if len(w) >= seed:
            g = gram_hashes(w, seed)
            h.append(g)
            item.append(np.full(len(g), len(keep)))
            place.append(np.arange(len(g)))
            keep.append(i)
            words.append(w)
    if not keep:
        return Items([], [], np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int))
    seeds = np.concatenate(h)
    order = np.argsort(seeds, kind="stable")
    return Items(keep, words, seeds[order], np.concatenate(item)[order], np.concatenate(place)[order])


def _fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the words before each place, each times a power of the base, and the powers' inverses."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_MULT, len(words)), out=total[1:])
    return total, _powers(_INV, len(words) + 1)


def common_runs(doc: np.ndarray, item: np.ndarray, least: int, step: int = 1_000_000) -> np.ndarray:
    """Rows (length, place in doc, place in item) of all runs of at least ``least`` words that cannot be made longer.

    Seeds of ``least`` words are joined by their hashes, about ``step`` pairs at a time; of those on a diagonal that follow
    each other only the first is kept, and its length is found by binary search over Karp-Rabin fingerprints.
    """
    if len(doc) < least or len(item) < least:
        return np.empty((0, 3), np.int64)
    own, seeds = gram_hashes(doc, least), gram_hashes(item, least)
    order = np.argsort(seeds, kind="stable")
    seeds = seeds[order]
    lo, hi = np.searchsorted(seeds, own), np.searchsorted(seeds, own, side="right")
    live = np.flatnonzero(hi > lo)
    total_d, down_d = _fingerprints(doc)
    total_i, down_i = _fingerprints(item)
    out = []
    ends = np.cumsum((hi - lo)[live])
    cuts = [0, *np.unique(np.searchsorted(ends, np.arange(step, ends[-1] if len(ends) else 0, step)) + 1).tolist(), len(live)]
    for x, y in zip(cuts, cuts[1:]):
        at = live[x:y]
        n = (hi - lo)[at]
        d = np.repeat(at, n)
        p = order[np.repeat(lo[at] - (np.cumsum(n) - n), n) + np.arange(len(d))]
        first = (d == 0) | (p == 0)
        first[~first] = doc[d[~first] - 1] != item[p[~first] - 1]
        d, p = d[first], p[first]
        low, high = np.full(len(d), least), np.minimum(len(doc) - d, len(item) - p)
        while (todo := low < high).any():
            mid = (low + high + 1) // 2
            same = (total_d[d + mid] - total_d[d]) * down_d[d] == (total_i[p + mid] - total_i[p]) * down_i[p]
            low, high = np.where(todo & same, mid, low), np.where(todo & ~same, mid - 1, high)
        out.append(np.stack((low, d, p), axis=1))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of words: (place in doc, place in item, length) of the tiles.

    Always the longest run whose words are all free is marked, of equal ones the first in the document, then in the item.
    What is left of a run that a tile has cut is put back if it is long enough.
    """
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    queue = [(-n, d, p) for n, d, p in common_runs(doc, item, least).tolist()]
    heapify(queue)
    found: list[tuple[int, int, int]] = []
    left = len(item)
    while queue and left >= least:
        n, d, p = heappop(queue)
        n = -n
        free = free_d[d:d + n] & free_i[p:p + n]
        if free.all():
            free = doc[d:d + n] == item[p:p + n]  # fingerprints that met by chance
        if free.all():
            free_d[d:d + n] = free_i[p:p + n] = False
            found.append((d, p, n))
            left -= n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).view(np.int8)))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if y - x >= least:
                heappush(queue, (x - y, d + x, p + x))
    return found


def matches(texts: list[str | None], items: Items, coverage: float = COVERAGE, seed: int = SEED) -> list[tuple]:
    """(row, item, words of the item, covered words, number of tiles, longest tile) of every item found in a text."""
    out: list[tuple] = []
    if not len(items.seeds):
        return out
    raw = [plain(t) for t in texts]
    for a, b in batches([len(t) for t in raw]):
        words, row, *_ = word_hashes(raw[a:b])
        g = gram_hashes(words, seed)
        at = np.searchsorted(items.seeds, g)
        hit = np.flatnonzero((at < len(items.seeds)) & (items.seeds[np.minimum(at, len(items.seeds) - 1)] == g)
                             & (row[:len(g)] == row[seed - 1:]))
        if not len(hit):
            continue
        # each seed once a text, however often the text has it
        kinds = np.unique(np.stack((row[hit], at[hit]), axis=1), axis=0)
        n = np.searchsorted(items.seeds, items.seeds[kinds[:, 1]], side="right") - kinds[:, 1]
        place = np.repeat(kinds[:, 1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = np.stack((np.repeat(kinds[:, 0], n), items.item[place], items.place[place]), axis=1)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        new = np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(1)))
        # words of the item that its shared seeds cover: tiles lie within them
        gain = np.full(len(found), seed)
        gain[1:] = np.where(new[1:], seed, np.minimum(seed, found[1:, 2] - found[:-1, 2]))
        begin = np.flatnonzero(new)
        starts = np.searchsorted(row, np.arange(b - a + 1))
        for (r, i, _), covered in zip(found[begin].tolist(), np.add.reduceat(gain, begin).tolist()):
            n_words = len(items.words[i])
            if covered >= coverage * n_words:
                got = tiles(words[starts[r]:starts[r + 1]], items.words[i], seed)
                total = sum(t[2] for t in got)
                if total >= coverage * n_words:
                    out.append((a + r, items.ids[i], n_words, total, len(got), max(t[2] for t in got)))
    return out


def blocks(benchmark: DataFrame, words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items in blocks of about ``words`` words."""
    b = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (words * 6)))
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        yield index([r["item_id"] for r in rows], [r["text"] for r in rows])


def search(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and item found in it: ``doc_id``, ``item_id``, words, covered words, tiles, coverage."""
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
              f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, "
              "item_words long, covered long, n_tiles long, longest long, coverage double")
    spark = docs.sparkSession
    out = None
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def find(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = matches(list(frame["text"]), shared.value, coverage)
                if found:
                    rows = [f[0] for f in found]
                    yield pd.DataFrame({
                        "doc_id": frame["doc_id"].iloc[rows].to_numpy(), "item_id": [f[1] for f in found],
                        "item_words": [f[2] for f in found], "covered": [f[3] for f in found],
                        "n_tiles": [f[4] for f in found], "longest": [f[5] for f in found],
                        "coverage": [f[3] / f[2] for f in found]})

        part = docs.select("doc_id", "text").mapInPandas(releasing(find), schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows in which an item is found; all columns are kept as they are."""
    spark = docs.sparkSession
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def keep(frames, shared=shared):
            import pyarrow as pa

            for batch in frames:
                for at in range(0, batch.num_rows, 500):
                    few = batch.slice(at, 500)
                    found = {f[0] for f in matches(few.column("text").to_pylist(), shared.value, coverage)}
                    yield few.filter(pa.array([i not in found for i in range(few.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(releasing(keep), docs.schema)
    return docs
