"""Removal of repeated runs of words by suffix automata.

A word is removed if a window of ``LENGTH`` words covers it whose sequence also starts anywhere else, in the same
document or another; windows are judged on the input.

Texts are cut into stretches by :mod:`repeats`. The different stretches of some anchors are a reference shard; its
generalised suffix automaton counts, by state, at how many places of the corpus a run of words ends (a stretch that
stands at several places counts as often). Every stretch of the shard is streamed through the automaton: at each word
the matching statistic is the longest run ending there that has another place. Where it reaches ``LENGTH`` it yields a
maximal span. An automaton is sent to the stretches of its own anchors only, as no other stretch can hold its windows:
automata of the whole reference would grow with the corpus and are not broadcast to all tasks.

NULL, empty and wordless texts have nothing to remove. Repeated rows are places of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Unit, merged, numbered, spans, with_spans

LENGTH = 35
WORDS = Unit(words=True, length=LENGTH, gram=8)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Automaton:
    """Generalised suffix automaton of sequences, with the number of places of each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.places.append(0)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of ``q`` for the runs that end after ``p`` and ``c``."""
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def add(self, sequence: list[int], places: int) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
                last = new
            self.places[last] += places

    def close(self) -> list[int]:
        """By state, the length of its longest suffix with two places or more."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in reversed(order):
            self.places[self.link[v]] += self.places[v]
        again = [0] * len(self.length)
        for v in order:
            again[v] = self.length[v] if self.places[v] > 1 else again[self.link[v]]
        return again


def repeated(bodies: list[bytes], windows: np.ndarray, count: np.ndarray, rank: np.ndarray, lo: np.ndarray,
             length: int = LENGTH) -> tuple[list[list[int]], list[list[int]]]:
    """For each stretch the ranges of its windows that have another place."""
    ids: dict[bytes, int] = {}
    sequences = [[ids.setdefault(w, len(ids)) for w in b.split(b" ")] for b in bodies]
    automaton = Automaton()
    for s, c in zip(sequences, count):
        automaton.add(s, int(c))
    again = automaton.close()
    edges = automaton.next
    out = []
    for s in sequences:
        found: list[int] = []
        state = 0
        for i, c in enumerate(s):
            # the automaton holds the whole stretch: following it never fails
            state = edges[state][c]
            if again[state] >= length:
                a, b = i - again[state] + 1, i - length + 1
                if found and a <= found[-1] + 1:
                    found[-1] = b
                else:
                    found += [a, b]
        out.append(found)
    return out, [[] for _ in bodies]


def removed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, the word spans to remove as (start, end) pairs, and the text."""
    t = numbered(docs, key)
    return with_spans(t, spans(t, WORDS, repeated, keep_first=False)).select(F.col("own").alias(key), "spans", "text")


def digests(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``n_words``, ``n_removed``, ``kept_sha256`` of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, pairs in zip(frame["text"], frame["spans"]):
                words = _WORD.findall(text) if isinstance(text, str) else []
                gone = merged((r["a"], r["b"]) for r in pairs) if pairs is not None else []
                kept, at = [], 0
                for a, b in gone:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
            out.insert(0, key, frame[key].to_numpy())
            yield out

    return removed(docs, key).mapInPandas(digest, f"{key} {kind}, n_words long, n_removed long, kept_sha256 string")
