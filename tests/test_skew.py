"""Every operator gives the same rows whether a group fits a task or has to be split."""

import pytest
from conftest import same
from pyspark.sql import functions as F

from longpanel.functions import ordered as O
from longpanel.operators import accounting as G
from longpanel.operators import book as BK
from longpanel.operators import evaluate as E
from longpanel.operators import features_daily as D
from longpanel.operators import features_flow as FF
from longpanel.operators import labels as L
from longpanel.operators import metrics as M
from longpanel.operators import portfolio as P
from longpanel.operators import screen as S
from longpanel.operators import transforms as T
from longpanel.plans.catalog.microstructure import slot_panel
from longpanel.sources.panels import order_events, return_series, weekly_panel, weekly_panel_market

KEY = ["ts", "symbol"]


def both(hot, make, keys=KEY, tol=1e-9):
    a = make()
    a = O.durable(a)
    with hot:
        b = O.durable(make())
    same(a, b, keys, tol)


@pytest.fixture(scope="module")
def panel(spark, sf_dir):
    return O.annotate(O.durable(weekly_panel(spark, sf_dir)), {
        k: (weekly_panel(spark, sf_dir).schema[k].metadata[O.ROWS_KEY],
            weekly_panel(spark, sf_dir).schema[k].metadata[O.GROUPS_KEY]) for k in KEY})


def test_plans_differ(spark, panel, hot):
    assert not O.is_hot(panel, ["ts"])
    with hot:
        assert O.is_hot(panel, ["ts"]) and O.is_hot(panel, ["symbol"])


@pytest.mark.parametrize("kind", ["average", "ordinal"])
def test_rank(panel, hot, kind):
    x = panel.select(*KEY, F.when(F.col("volume") > 40, F.round("volume", -1)).alias("v"))
    both(hot, lambda: O.with_rank(x, ["ts"], "v", "r", kind=kind, ties=["symbol"]))


@pytest.mark.parametrize("how", ["linear", "nearest", "lower"])
def test_quantiles(panel, hot, how):
    x = panel.select(*KEY, F.col("vwap").alias("v"))
    both(hot, lambda: O.with_quantiles(x, ["ts"], "v", {"a": 0.5, "b": 0.1}, how))


def test_trailing_and_running(panel, hot):
    x = panel.select(*KEY, F.log("vwap").alias("v"))
    both(hot, lambda: O.with_trailing(x, ["symbol"], ["ts"], 9, lambda d, t: d.withColumns({
        "m": t.mean(F.col("v"), 9, 3), "l": t.lag(F.col("v"), 5)})))
    y = x.withColumn("v", F.when(F.col("v") > 7, F.col("v")))
    both(hot, lambda: O.with_running(y, ["symbol"], ["ts"], {
        "s": ("sum", F.coalesce("v", F.lit(0.0))), "p": ("product", 1 + F.coalesce("v", F.lit(0.0)) / 100),
        "m": ("max", F.coalesce("v", F.lit(0.0))), "f": ("last", F.col("v"))}))


def test_ordinals(panel, hot):
    both(hot, lambda: O.with_ordinal(panel.select(*KEY), "ts"))


def test_labels(panel, hot):
    both(hot, lambda: L.forward_returns(panel.select(*KEY, "vwap"), {"y1": 1, "y5": 5}))
    both(hot, lambda: L.vol_normalized_return(panel.select(*KEY, "vwap"), 2, vol_window=5))


@pytest.mark.parametrize("step", [
    {"op": "winsorize", "column": "x", "k": 1.0},
    {"op": "winsorize", "column": "x", "method": "quantile", "lower": 0.2, "upper": 0.8},
    {"op": "zscore", "column": "x"}, {"op": "rank_to_normal", "column": "x"},
    {"op": "neutralize", "column": "x", "min_names": 3},
    {"op": "rolling_zscore", "column": "x", "window": 5},
    {"op": "rolling_quantile", "column": "x", "window": 5},
    {"op": "ema_ratio", "column": "x", "fast": 3, "slow": 8}])
def test_transforms(panel, hot, step):
    x = panel.select(*KEY, F.log("vwap").alias("x"), "industry", "market_cap")
    both(hot, lambda: T.apply_steps(x, [step]), tol=1e-8)


def test_forward_fill(panel, hot):
    x = panel.select(*KEY, F.when(F.col("volume") > 60, F.col("vwap")).alias("x"))
    both(hot, lambda: T.forward_fill(x, "x"))


def test_daily_features(spark, sf_dir, hot):
    both(hot, lambda: D.compute_features(weekly_panel_market(spark, sf_dir)), tol=1e-6)


def test_evaluation(panel, hot):
    def st():
        return L.forward_returns(panel, {"y1": 1})

    f = ["log_volume", "close"]
    both(hot, lambda: E.ic(st(), f, "y1", min_names=3), ["factor", "ts"])
    both(hot, lambda: E.ic_summary(E.ic(st(), f, "y1", min_names=3), newey_west_lags=3), ["factor"])
    both(hot, lambda: E.bucketed(st(), f, "y1", 2), ["factor", "ts", "bucket"])
    both(hot, lambda: E.turnover(st(), f, min_names=3), ["factor", "ts"])
    both(hot, lambda: E.quantile_summary(E.bucketed(st(), f, "y1", 2), 2, 400), ["factor"])


def test_screen(panel, hot):
    f = ["log_volume", "close", "open", "amount"]
    both(hot, lambda: S.correlation_pairs(panel, f, min_names=3), ["f1", "f2"])
    x = panel.select(*KEY, *f)
    both(hot, lambda: S.orthogonalize(x, "close", ["log_volume", "amount"], min_names=4), tol=1e-6)
    both(hot, lambda: S.orthogonalize(x, "close", ["log_volume"], method="symmetric", min_names=4),
         tol=1e-6)


def test_weights(panel, hot):
    x = panel.select(*KEY, "industry", F.col("vwap").alias("score"))
    c = P.Constraints(max_weight=0.2, min_weight=-0.2, max_industry=0.3)
    both(hot, lambda: P.score_to_weight(x, constraints=c), tol=1e-7)
    for m in ("equal", "score"):
        both(hot, lambda m=m: P.score_to_weight(x, method=m))


def test_accounting(panel, hot):
    w = P.score_to_weight(panel.select(*KEY, F.col("vwap").alias("score"))).withColumn(
        "weight", F.col("weight") * 0.05)
    px = panel.select(*KEY, F.log("vwap").alias("vwap"))
    both(hot, lambda: G.simulate_gross(w, px, capital=1e6), ["book_id", "ts"], tol=1e-7)


def test_metrics(spark, sf_dir, hot):
    s = return_series(spark, sf_dir).withColumn("ret", (F.col("ret") - 3) * 0.01)
    both(hot, lambda: M.performance(s, ppy=52.0), ["series"], tol=1e-7)
    both(hot, lambda: M.rolling_sharpe(s, ppy=52.0), ["series", "ts"], tol=1e-7)


def test_flow_and_book(spark, sf_dir, hot):
    both(hot, lambda: FF.build_flow_features(slot_panel(spark, sf_dir), window=6), ["slot", "symbol"],
         tol=1e-6)
    both(hot, lambda: BK.book_snapshots(order_events(spark, sf_dir), 3600 * 10**9),
         ["slot", "symbol"])
