"""Removal of repeated substrings by merged Burrows-Wheeler transforms.

A byte is removed if a string of ``LENGTH`` bytes covers it that also starts earlier: in a document of smaller key, or
earlier in the same one. Strings lie within a document and are judged on the input.

Texts are cut into stretches by :mod:`repeats`; the different stretches of an anchor are what may share long strings.
They are dealt into shards. Each shard's transform comes from its own sorted rotations. The transforms are merged by
iterative interleave refinement: the merged order starts as one shard after another; each step walks it, prepends to
every rotation the symbols that its transform holds, and files it by them, stably, at the place that its shard's
last-to-first map gives. After ``h`` symbols the order is that of the first ``h`` symbols of all rotations; no suffix is
sorted again. Block borders that appear on the way are the common prefixes: rotations in one block after ``LENGTH``
symbols are one repeated interval. Of its places the first keeps its bytes. Stretches that have no long enough part in
common with another one are left out before.

Symbols are UTF-8 bytes; FF, which UTF-8 never holds, ends a stretch. NULL and empty texts have nothing to remove.
Repeated rows count as places of their own; equal keys are ordered by row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Unit, merged, numbered, spans, with_spans
from .words import U, Hasher, _BYTES

LENGTH = 100
BYTES = Unit(words=False, length=LENGTH, gram=48)
_HASH = Hasher()
#: Bytes of a shard whose rotations are sorted by themselves.
SHARD = 32_768
#: Parts of the places of windows by which stretches without a partner are told.
PARTS = 4
#: Most symbols that one step of the refinement prepends.
STEP = 8


def transform(text: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rotations (places in ``text``) of the stretches of one shard and their transform.

    ``after`` and ``before`` give the next and the previous place within a stretch, around its end.
    """
    n = len(text)
    # rotations that agree on as many symbols as the two longest stretches have are equal
    longest = 2 * int(np.diff(np.flatnonzero(after != np.arange(1, n + 1)), prepend=-1).max())
    key = np.zeros(n, np.uint64)
    at = np.arange(n)
    for _ in range(8):
        key = (key << np.uint64(8)) | text[at]
        at = after[at]
    step, jump = 8, at
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        number = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        rank = np.zeros(n, np.uint64)
        rank[order[1:]] = number
        if n < 2 or int(number[-1]) == n - 1 or step > longest:
            # rotations that are equal stand in the order of their places
            order = order if n < 2 or int(number[-1]) == n - 1 else np.argsort(rank, kind="stable")
            return order, text[before[order]]
        key = (rank << np.uint64(32)) | rank[jump]
        jump = jump[jump]
        step *= 2


def refined(transforms: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of all rotations of the shards, and the number of each one's block of equal first ``length`` symbols.

    An entry of the order is a rotation's place in its shard's own order, shards one after another. Up to ``STEP``
    symbols are taken at a step, while different ones are few enough for 16 bits; what is left takes smaller steps.
    """
    b = np.concatenate(transforms)
    last_to_first = np.empty(len(b), np.int32)
    base = 0
    for t in transforms:
        last_to_first[base + np.argsort(t, kind="stable")] = np.arange(base, base + len(t), dtype=np.int32)
        base += len(t)
    steps = [(1, b.astype(np.uint16), last_to_first)]
    while steps[-1][0] < STEP and 2 * steps[-1][0] <= length:
        n, symbol, to = steps[-1]
        # what is prepended in two steps, numbered in order
        pair = (symbol[to].astype(np.uint32) << np.uint32(16)) | symbol
        s = np.argsort(symbol, kind="stable")
        s = s[np.argsort(symbol[to][s], kind="stable")]
        pair = pair[s]
        number = np.cumsum(pair[1:] != pair[:-1])
        if len(number) and number[-1] >= 1 << 16:
            break
        both = np.zeros(len(b), np.uint16)
        both[s[1:]] = number
        steps.append((2 * n, both, to[to]))
    order, block = np.arange(len(b), dtype=np.int32), np.zeros(len(b), np.int32)
    blocks = 1
    done = 0
    while done < length:
        n, symbols, to = next(x for x in reversed(steps) if x[0] <= length - done)
        k = symbols[order]
        s = np.argsort(k, kind="stable")
        k, old = k[s], block[s]
        block = np.zeros(len(b), np.int32)
        np.cumsum((k[1:] != k[:-1]) | (old[1:] != old[:-1]), out=block[1:])
        order = to[order[s]]
        done += n
        now = int(block[-1]) + 1
        if now == blocks and n == steps[-1][0] or now == len(b):
            break
        blocks = now
    return order, block


def repeated(bodies: list[bytes], windows: np.ndarray, count: np.ndarray, rank: np.ndarray, lo: np.ndarray,
             length: int = LENGTH, shard: int = SHARD) -> tuple[list[list[int]], list[list[int]]]:
    """For each stretch the ranges of windows that repeat elsewhere first, and of those that only its own copies repeat."""
    some = partnered(bodies, windows, length)
    if not some.all():
        always: list[list[int]] = [[] for _ in bodies]
        later = [[] if s or c < 2 else [0, int(n) - 1] for s, c, n in zip(some, count, windows)]
        few = np.flatnonzero(some)
        if len(few):
            found = merge([bodies[i] for i in few], windows[few], count[few], rank[few], lo[few], length, shard)
            for i, x, y in zip(few.tolist(), *found):
                always[i], later[i] = x, y
        return always, later
    return merge(bodies, windows, count, rank, lo, length, shard)


def partnered(bodies: list[bytes], windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each stretch may have a window in common with another one.

    A window begins at one of ``gap`` places before its anchor. These are taken in ``PARTS``; windows of one part have
    most of their bytes in common, and a stretch that shares none of these has no partner.
    """
    gram, gap = BYTES.gram, length - BYTES.gram + 1
    if length != BYTES.length or (windows > gap).any():
        return np.ones(len(bodies), bool)
    text = np.frombuffer(b"".join(bodies), np.uint8)
    end = np.cumsum([len(x) for x in bodies])
    start = end - np.fromiter(map(len, bodies), np.int64, len(bodies))
    g = _HASH.runs(_BYTES[text], gram) & ~U((1 << 24) - 1)
    # the anchor: the leftmost smallest run that all windows hold
    first = start + windows - 1
    at = np.minimum(first[:, None] + np.arange(gap), (start + length - gram)[:, None])
    anchor = at[np.arange(len(at)), np.argmin(g[at], axis=1)]
    total, down = _HASH.sums(_BYTES[text]), _HASH.down
    some = np.zeros(len(bodies), bool)
    cut = np.linspace(0, gap, PARTS + 1).astype(np.int64)
    for a, b in zip(cut[:-1], cut[1:]):
        x, y = anchor - a, anchor + length - b + 1
        held = np.flatnonzero((x >= start) & (y <= end))
        key = (total[y[held]] - total[x[held]]) * down[x[held]]
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        some[held[times[which] > 1]] = True
    return some


def merge(bodies: list[bytes], windows: np.ndarray, count: np.ndarray, rank: np.ndarray, lo: np.ndarray,
          length: int = LENGTH, shard: int = SHARD) -> tuple[list[list[int]], list[list[int]]]:
    """As :func:`repeated`, by the merged transforms of all the stretches."""
    text = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8)
    end = np.cumsum([len(x) + 1 for x in bodies])
    start = np.concatenate(([0], end[:-1]))
    after, before = np.arange(1, len(text) + 1), np.arange(-1, len(text) - 1)
    after[end - 1], before[start] = start, end - 1
    places, transforms = [], []
    first = 0
    for i in range(len(bodies)):
        if end[i] - start[first] >= shard or i == len(bodies) - 1:
            a, z = start[first], end[i]
            order, t = transform(text[a:z], after[a:z] - a, before[a:z] - a)
            places.append(order + a)
            transforms.append(t)
            first = i + 1
    order, block = refined(transforms, length)
    at = np.concatenate(places)[order]
    owner = np.repeat(np.arange(len(bodies)), np.diff(np.append(start, end[-1])))[at]
    off = at - start[owner]
    own = off < windows[owner]
    owner, off, block = owner[own], off[own], block[own]
    # the first place of each repeated interval
    turn = np.lexsort((lo[owner] + off, rank[owner], block))
    owner, off, block = owner[turn], off[turn], block[turn]
    head = np.concatenate(([True], block[1:] != block[:-1])) if len(block) else np.zeros(0, bool)
    return ranges(owner[~head], off[~head], len(bodies)), ranges(owner[head & (count[owner] > 1)], off[head & (count[owner] > 1)], len(bodies))


def ranges(owner: np.ndarray, off: np.ndarray, n: int) -> list[list[int]]:
    """(first, last, first, last, ...) of the runs of ``off`` of each owner."""
    out: list[list[int]] = [[] for _ in range(n)]
    if len(owner):
        turn = np.lexsort((off, owner))
        owner, off = owner[turn], off[turn]
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (off[1:] != off[:-1] + 1)) + 1
        for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(owner)]))):
            out[owner[a]] += [int(off[a]), int(off[b - 1])]
    return out


def removed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, the byte spans to remove as (start, end) pairs, and the text."""
    t = numbered(docs, key)
    return with_spans(t, spans(t, BYTES, repeated, keep_first=True)).select(F.col("own").alias(key), "spans", "text")


def digests(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, pairs in zip(frame["text"], frame["spans"]):
                raw = text.encode() if isinstance(text, str) else b""
                gone = merged((r["a"], r["b"]) for r in pairs) if pairs is not None else []
                h, at = hashlib.sha256(), 0
                for a, b in gone:
                    h.update(raw[at:a])
                    at = b
                h.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in gone), len(gone), h.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, key, frame[key].to_numpy())
            yield out

    return removed(docs, key).mapInPandas(digest, f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
