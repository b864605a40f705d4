"""Trailing order statistics against brute force: every window, NULLs, NaN, kinds, pieces and oversized groups."""

import math
import random

import numpy as np
import pytest

from longpanel.functions import order_stats as O
from longpanel.operators import transforms as T


def test_wavelet_matrix():
    r = np.random.default_rng(1)
    for m in (1, 2, 3, 17, 64):
        x = r.integers(0, m, 300)
        w = O.WaveletMatrix(x, m)
        a, b = np.sort(r.integers(0, 301, (2, 500)), axis=0)
        ok = a < b
        a, b = a[ok], b[ok]
        k = (r.random(len(a)) * (b - a)).astype(int)
        assert w.kth(a, b, k).tolist() == [sorted(x[i:j])[n] for i, j, n in zip(a, b, k)]
        v = r.integers(0, m, len(a))
        assert w.below(a, b, v).tolist() == [int((x[i:j] < n).sum()) for i, j, n in zip(a, b, v)]


def quantile(xs, q, how):
    if not xs:
        return None
    k = q * (len(xs) - 1)
    if how == "linear":
        lo = math.floor(k)
        hi = min(lo + 1, len(xs) - 1)
        return xs[lo] if k == lo else xs[lo] + (xs[hi] - xs[lo]) * (k - lo)
    return xs[math.floor(k + 0.5) if how == "nearest" else math.floor(k)]


def brute(rows, window, q, how, need):
    out = {}
    by = {}
    for s, t, x in rows:
        by.setdefault(s, []).append((t, x))
    for s, v in by.items():
        v.sort()
        for i, (t, x) in enumerate(v):
            w = sorted((y for _, y in v[max(0, i - window + 1):i + 1] if y is not None), key=lambda y: (y != y, y))
            rank = sum(y < x or (x != x and y == y) for y in w) / len(w) if x is not None and len(w) >= need else None
            out[(s, t)] = (quantile(w, q, how) if len(w) >= need else None, rank)
    return out


def rows(seed):
    r = random.Random(seed)
    out = []
    for s in ["a"] * 120 + ["b"] * 30 + ["c"] + [None] * 20 + ["d"] * 40:
        x = None if r.random() < 0.2 or s == "d" else float(r.randrange(-9, 9)) if r.random() < 0.5 else r.random()
        out.append((s, len(out), x))
    return out


@pytest.mark.parametrize("window,how,need", [(2, "nearest", 2), (7, "linear", 3), (50, "lower", 1), (500, "linear", 5), (500, "nearest", 0)])
def test_rolling_quantile_and_rank(spark, hot, monkeypatch, window, how, need):
    monkeypatch.setattr(O, "PIECE", 16)
    data = rows(window)
    d = spark.createDataFrame(data, "symbol string, ts int, x double").repartition(4)
    want = brute(data, window, 0.3, how, need)

    def check():
        a = T.rolling_quantile(d, "x", window=window, quantile=0.3, interpolation=how, out="q", min_periods=need)
        a = T.rolling_rank(a, "x", window=window, out="k", min_periods=need)
        got = {(r.symbol, r.ts): (r.q, r.k) for r in a.collect()}
        assert got.keys() == want.keys()
        for k in want:
            for u, v in zip(got[k], want[k]):
                assert (u is None) == (v is None) and (u is None or math.isclose(u, v, rel_tol=1e-12, abs_tol=1e-12)), (k, got[k], want[k])

    check()
    if window < 20:
        with hot:
            check()


def test_kinds_nan_and_empty_frames(spark):
    big = [("a", t, 2**60 + t % 5) for t in range(40)]
    got = T.rolling_quantile(spark.createDataFrame(big, "symbol string, ts int, x long"), "x", window=9, min_periods=1, out="q")
    assert got.schema["q"].dataType.simpleString() == "bigint"
    want = brute(big, 9, 0.5, "nearest", 1)
    assert {(r.symbol, r.ts): r.q for r in got.collect()} == {k: v[0] for k, v in want.items()}
    nan = spark.createDataFrame([("a", t, float("nan") if t % 3 == 0 else float(t)) for t in range(12)], "symbol string, ts int, x double")
    top = T.rolling_quantile(nan, "x", window=4, quantile=1.0, min_periods=1, out="q").collect()
    assert all(math.isnan(r.q) for r in top)
    none = T.rolling_rank(nan.limit(0), "x", window=4, out="k")
    assert none.columns == ["symbol", "ts", "x", "k"] and none.count() == 0
    with pytest.raises(ValueError):
        T.rolling_quantile(nan, "x", window=1)
    with pytest.raises(ValueError):
        T.rolling_quantile(nan, "x", window=4, interpolation="mean")


def test_cost_does_not_grow_with_the_window():
    import time

    x = np.random.default_rng(0).random(200_000)
    at = np.arange(len(x))
    took = []
    for window in (20, 100_000):
        t = time.process_time()
        O.windowed(x, np.zeros(len(x), bool), np.maximum(0, at - window + 1), {"q": ("quantile", 0.5, "nearest"), "b": ("below",)})
        took.append(time.process_time() - t)
    assert took[1] < 6 * took[0] + 0.5
