"""Runs against brute force on small alphabets, on planted texts and in pieces."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from longpanel.llm import periodic_runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute(w):
    """Maximal stretches by trying every period; the smallest period of each."""
    out, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in out.items())


def samples(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        k = r.choice([1, 2, 3, 50])
        w = [r.randrange(k) for _ in range(r.randint(0, 90))]
        for _ in range(r.randint(0, 4)):
            unit = [r.randrange(k) for _ in range(r.randint(1, 40))]
            w += (unit * r.randint(2, 9))[:-r.randint(1, len(unit)) or None] + [r.randrange(k) for _ in range(r.randint(0, 20))]
        yield w


def test_runs_of_small_alphabets():
    batch = list(samples(1, 400))
    texts = [" ".join(map(str, w)).encode() for w in batch]
    for at in range(0, len(texts), 7):
        counts, runs = R.text_runs(texts[at:at + 7])
        for w, n, got in zip(batch[at:at + 7], counts, runs):
            assert n == len(w) and [tuple(x) for x in got.tolist()] == brute(w)


def test_appends_of_any_size_give_the_same():
    r = random.Random(4)
    for w in samples(2, 120):
        x, at = np.array(w, np.int64), 0
        c = R.Catchers(len(w))
        while at < len(x):
            step = r.choice([1, 2, 7, 30, 200])
            c.append(x[at:at + step])
            at += step
        assert [tuple(v) for v in c.close().tolist()] == brute(w)


def test_fingerprints_that_meet_are_checked_word_by_word(monkeypatch):
    monkeypatch.setattr(R, "mix", lambda x: x * np.uint64(0))
    for w in ([1, 2, 3] * 12 + [4, 5], list(range(40)) + [7] * 30, list(range(60))):
        c = R.Catchers(len(w))
        c.append(np.array(w, np.int64))
        got = {tuple(v) for v in c.close().tolist()}
        assert got <= set(brute(w))


def test_long_repetitive_texts_take_little_time_and_pieces(monkeypatch):
    monkeypatch.setattr(R, "PIECE", 1000)
    n = 300_000
    assert R.text_runs([b"na " * n])[1][0].tolist() == [[0, n, 1]]
    unit = [b"w%d" % i for i in range(50_000)]
    t = b" ".join(unit * 4 + unit[:123] + [b"end"])
    counts, runs = R.text_runs([t])
    assert counts == [200_124] and runs[0].tolist() == [[0, 200_123, 50_000]]
    assert R.without(t, counts[0], runs[0]) == b" ".join([*unit, b"end"])
    fib = ["a", "b"]
    while len(fib[-1]) < 40_000:
        fib.append(fib[-1] + fib[-2])
    assert R.text_runs([" ".join(fib[-1]).encode()])[1][0].shape[1] == 3


def laid(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = laid(doc_id, text)
    runs = brute(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    head = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *head, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def corpus():
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randint(1, 200))) for _ in range(150)]
    texts += [" ".join(str(r.randrange(2)) for _ in range(150)) for _ in range(40)]
    texts += ["é a\tb\x0b " * 40, "  lead and tail  ", "a\n\n b", "", None, " \t\r\n", "x " * 24, "x " * 23, "line\x0cone line\x1cone " * 30]
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "y " * 60, None, None, None), (3, "y z " * 60, None, None, None), (3, "y z " * 60, None, None, None)]


def test_digests_against_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, DOC).repartition(6)
    for c in ("key", "size", "runs", "w", "n", "a", "p", "g", "h", "best", "collapsed"):
        d = d.withColumn(c, F.lit("clash"))
    got = sorted(map(tuple, R.digests(d).collect()), key=repr)
    assert got == sorted((expected(r[0], r[1]) for r in rows), key=repr)
    assert sum(r[1] for r in got) > 15


@pytest.mark.parametrize("texts", [[], [None, ""], ["x"]])
def test_small_tables(spark, texts):
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC)
    assert sorted(map(tuple, R.digests(d).collect())) == sorted(expected(i, t) for i, t in enumerate(texts))


def test_small_batches_and_general_keys(spark, monkeypatch):
    d = spark.createDataFrame([("k", "a b c " * 20), ("l", None)], "id string, body string")
    got = {r.id: r for r in R.find(d, key="id", text="body").collect()}
    assert [tuple(x) for x in got["k"].runs] == [(0, 60, 3)] and got["k"].collapsed == "a b c" and got["l"].collapsed == "" and got["l"].n_words == 0
