"""Trailing statistics in one pass of Arrow batches, and bars that go to their symbol once."""

import contextlib
import io
import math
import random
import statistics

from longpanel.functions.ordered import Trail
from longpanel.operators import features_daily as D
from longpanel.sources.panels import bars, weekly_panel, weekly_panel_market

from conftest import rows


def brute(kind, n, x, y=None):
    x = x[-n:]
    if len(x) < n or None in x:
        return None
    if kind == "corr":
        y = y[-n:]
        if None in y or len(set(x)) == 1 or len(set(y)) == 1:
            return None
        return statistics.correlation(x, y)
    return {"mean": statistics.fmean, "sum": sum, "max": max, "min": min, "std": statistics.stdev,
            "below": lambda v: sum(a < v[-1] for a in v)}[kind](x)


def test_windows_across_batches_and_keys(spark):
    rng = random.Random(3)
    data = [(k, i, None if rng.random() < 0.1 else (1 / 3 if k == "b" else rng.random()), rng.choice([0.1, 0.7, 1.9]))
            for k, m in (("a", 23), ("b", 9), ("c", 2), ("d", 40)) for i in range(m)]
    df = spark.createDataFrame(data, "k string, i int, x double, y double")
    specs = {f"{kind}_{n}": (kind, *(("x", "y") if kind == "corr" else ("x",)), n)
             for kind in ("mean", "sum", "std", "max", "min", "corr", "below") for n in (3, 5)}
    nested = {"_m": ("mean", "x", 3), "_d": (lambda v, m: v - m, "x", "_m"), "dev": ("sum", "_d", 3)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = rows(Trail(["k"], ["i"]).stats(df, specs | nested), "k", "i")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(data)
    for r in got:
        past = [d for d in data if d[0] == r["k"] and d[1] <= r["i"]]
        x, y = [d[2] for d in past], [d[3] for d in past]
        for name, (kind, *_, n) in specs.items():
            want = brute(kind, n, x, y)
            assert (r[name] is None) == (want is None), (name, r)
            assert want is None or math.isclose(r[name], want, rel_tol=1e-9, abs_tol=1e-12), (name, r)
        dev = [x[j] - brute("mean", 3, x[:j + 1]) if brute("mean", 3, x[:j + 1]) is not None else None for j in range(len(x))]
        want = brute("sum", 3, dev)
        assert (r["dev"] is None) == (want is None) and (want is None or math.isclose(r["dev"], want, abs_tol=1e-12))


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_no_window_function_goes_over_a_long_frame(spark, sf_dir):
    text = plan(D.compute_features(weekly_panel_market(spark, sf_dir)))
    assert "RowFrame, -19" not in text and "RowFrame, -59" not in text


def test_records_are_shuffled_once_for_bars_and_panel(spark, sf_dir):
    assert plan(bars(spark, sf_dir)).count("Exchange hashpartitioning") == 1
    # the other is that of the names
    assert plan(weekly_panel(spark, sf_dir)).count("Exchange hashpartitioning") == 2
