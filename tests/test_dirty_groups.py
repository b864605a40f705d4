"""Operators on filtered panels, repeated keys, NULL ties and NULL values: one result whatever the group size."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from longpanel.functions import ordered as O
from longpanel.operators.labels import forward_returns
from longpanel.operators.masks import build_masks
from longpanel.operators.validate import CombinatorialPurgedCV, PurgedWalkForward

TS0 = dt.datetime(2020, 1, 1)


def days(spark, n, symbols=("a",)):
    data = [(TS0 + dt.timedelta(days=i), s, 10.0 + i) for i in range(n) for s in symbols]
    return spark.createDataFrame(data, "ts timestamp_ntz, symbol string, vwap double")


def both(hot, make):
    """Rows of the ordinary plan, after asserting that the plan for large groups gives the same."""
    plain = [tuple(r.items()) for r in rows(make())]
    with hot:
        large = [tuple(r.items()) for r in rows(make())]
    assert plain == large
    return [dict(r) for r in plain]


def test_splits_of_a_filtered_panel_count_its_own_stamps(spark):
    whole = O.measure(days(spark, 357), "ts", "symbol")
    cut = whole.where(F.col("ts") < F.lit(TS0 + dt.timedelta(days=60)))
    roles = rows(PurgedWalkForward(20, 10).split(cut), "fold", "ord")
    assert {r["fold"] for r in roles} == {0, 1, 2, 3}
    for k in range(4):
        assert {r["role"] for r in roles if r["fold"] == k} == {"train", "test"}
    folds = rows(CombinatorialPurgedCV(6, 2).split(cut), "fold", "ord")
    assert all({r["role"] for r in folds if r["fold"] == k} == {"train", "test"} for k in range(15))
    assert sum(r["role"] == "test" for r in folds if r["fold"] == 0) == 20
    with pytest.raises(ValueError):
        PurgedWalkForward(250, 60).split(cut)


def test_a_short_filtered_sample_flags_nothing_as_new(spark):
    base = days(spark, 100).select("ts", "symbol", *[F.col("vwap").alias(c) for c in ("open", "high", "low", "close", "prev_close")],
                                   F.lit(5.0).alias("volume"))
    cut = O.measure(base, "ts", "symbol").where(F.col("ts") < F.lit(TS0 + dt.timedelta(days=40)))
    assert build_masks(cut, min_sessions=60).where("newly_listed").count() == 0
    assert build_masks(base, min_sessions=60).where("newly_listed").count() == 60


def test_labels_of_repeated_keys_do_not_multiply(spark, hot):
    d = days(spark, 12).union(days(spark, 12))
    assert len(both(hot, lambda: forward_returns(d, {"y": 2}))) == 24


def test_ordinal_ranks_of_equal_rows_and_null_ties(spark, hot):
    data = [("g", 1.0, "x"), ("g", 1.0, "x"), ("g", 1.0, "x"), ("g", 1.0, None), ("g", 2.0, None), ("g", None, "x"),
            *[("g", 3.0 + i, "x") for i in range(6)], (None, 1.0, "x"), (None, 0.5, None)]
    d = spark.createDataFrame(data, "g string, v double, t string")
    got = both(hot, lambda: O.with_rank(d, ["g"], "v", "r", kind="ordinal", ties=["t"]))
    assert sorted(r["r"] for r in got if r["g"] == "g" and r["r"] is not None) == list(range(1, 12))
    both(hot, lambda: O.with_rank(d, ["g"], "v", "r"))


def test_running_values_over_nulls(spark, hot):
    data = [("g", i, None if i % 4 == 3 or i in (0, 1) else float(i)) for i in range(20)] + [(None, i, 1.0) for i in range(9)]
    d = spark.createDataFrame(data, "g string, i int, x double")
    both(hot, lambda: O.with_running(d, ["g"], ["i"], {"s": ("sum", F.col("x")), "p": ("product", F.col("x")),
                                                       "m": ("max", F.col("x")), "l": ("last", F.col("x"))}))


def test_running_and_trailing_with_a_null_order_key(spark, hot):
    d = spark.createDataFrame([("g", None, 5.0), *[("g", i, float(i)) for i in range(20)]], "g string, i int, x double")
    both(hot, lambda: O.with_running(d, ["g"], ["i"], {"s": ("sum", F.col("x"))}))
    both(hot, lambda: O.with_trailing(d, ["g"], ["i"], 3, lambda f, t: f.withColumn("m", t.mean(F.col("x"), 3))))


@pytest.mark.parametrize("how", ["linear", "lower", "nearest"])
def test_a_group_without_values_has_null_quantiles(spark, hot, how):
    data = [("a", None)] * 9 + [("b", float(i)) for i in range(9)] + [(None, 1.0), (None, 2.0)]
    d = spark.createDataFrame(data, "g string, v double")
    got = both(hot, lambda: O.group_quantiles(d, ["g"], "v", {"q": 0.25}, how))
    assert {r["g"]: r["q"] for r in got}["a"] is None and len(got) == 3


def test_statistics_of_the_null_group(spark, hot):
    d = spark.createDataFrame([(None, float(i)) for i in range(9)] + [("a", 1.0)], "g string, v double")
    got = both(hot, lambda: O.over_group(d, ["g"], {"n": F.count("v")}))
    assert {r["n"] for r in got if r["g"] is None} == {9}


def test_bounds_follow_rewritten_data(spark, tmp_path):
    from longpanel.sources import panels

    path = str(tmp_path / "t")
    for n in (3, 8):
        days(spark, n).write.mode("overwrite").parquet(path)
        df = panels._bounded(spark.read.parquet(path), (path, "t"), "ts")
        assert O.value_bound(df, "ts") == n
