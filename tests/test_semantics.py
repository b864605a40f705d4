"""Rules on small frames, stated as exact numbers."""

import datetime as dt
import math
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from longpanel.errors import (LeakageError, ParityError, PointInTimeError, SchemaMismatch,
                              UniverseError)
from longpanel.functions import ticks as K
from longpanel.functions.normal import inverse_normal
from longpanel.operators import accounting as G
from longpanel.operators import adjust as A
from longpanel.operators import book as BK
from longpanel.operators import calendar as C
from longpanel.operators import costs as B
from longpanel.operators import covariance as KV
from longpanel.operators import evaluate as E
from longpanel.operators import labels as L
from longpanel.operators import masks as M
from longpanel.operators import portfolio as P
from longpanel.operators import prepare as PR
from longpanel.operators import screen as S
from longpanel.operators import tick_audit as TA
from longpanel.operators import transforms as T
from longpanel.operators import universe as U
from longpanel.operators import validate as V
from longpanel.sources import tables as ST

D0 = dt.datetime(2024, 1, 1)


def stamp(k):
    return D0 + dt.timedelta(days=k)


def frame(spark, data, cols):
    return spark.createDataFrame(data, cols).withColumn("ts", F.col("ts").cast("timestamp_ntz")) \
        if "ts" in cols else spark.createDataFrame(data, cols)


@pytest.fixture(scope="module")
def toy(spark):
    """Symbol B misses slot 2."""
    data = [(stamp(k), "A", 10.0 + k) for k in range(5)] + [
        (stamp(k), "B", 20.0 * 1.1 ** k) for k in range(5) if k != 2]
    return frame(spark, data, ["ts", "symbol", "vwap"])


# ------------------------------------------------------------------ labels


def test_label_skips_gap(toy):
    y = {(r["symbol"], r["ts"]): r["fwd_ret"] for r in rows(L.forward_return(toy, 1))}
    assert y["A", stamp(0)] == pytest.approx(12 / 11 - 1)
    assert y["B", stamp(0)] is None and y["B", stamp(1)] is None
    assert y["B", stamp(2 + 1)] is None and y["A", stamp(3)] is None


def test_label_future_does_not_leak(toy):
    full = {(r["symbol"], r["ts"]): r["fwd_ret"] for r in rows(L.forward_return(toy, 1))}
    cut = toy.where(F.col("ts") <= F.lit(stamp(3)).cast("timestamp_ntz"))
    for r in rows(L.forward_return(cut, 1)):
        if r["fwd_ret"] is not None:
            assert r["fwd_ret"] == full[r["symbol"], r["ts"]]


def test_label_guards(toy):
    with pytest.raises(ValueError):
        L.forward_return(toy, 0)
    with pytest.raises(PointInTimeError):
        L.assert_no_overlap(toy, toy, n=1, entry_lag=0)
    with pytest.raises(PointInTimeError):
        L.assert_no_overlap(toy, toy.withColumn("symbol", F.lit("Z")), n=1)
    L.assert_no_overlap(toy, toy, n=1)
    with pytest.warns(UserWarning):
        L.forward_return(toy.withColumnRenamed("vwap", "close"), 1, "close")


# ------------------------------------------------------------------ transforms


def test_inverse_normal_matches_stdlib(spark):
    ps = [1e-9, 1e-6, 0.001, 0.07, 0.2, 0.5, 0.6, 0.93, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", inverse_normal(F.col("p")).alias("z"))
    for r in df.collect():
        assert r["z"] == pytest.approx(statistics.NormalDist().inv_cdf(r["p"]), abs=1e-9)


def test_zscore_of_constant_is_null(spark):
    df = frame(spark, [(D0, s, 5.0) for s in "ABC"], ["ts", "symbol", "x"])
    assert all(r["x"] is None for r in T.zscore(df, "x").collect())
    # a cross-section without spread is not clipped either
    assert all(r["x"] == 5.0 for r in T.winsorize(df, "x").collect())


def test_rank_to_normal_ties_and_single(spark):
    df = frame(spark, [(D0, "A", 1.0), (D0, "B", 1.0), (D0, "C", 2.0), (stamp(1), "A", 3.0)],
               ["ts", "symbol", "x"])
    got = {(r["ts"], r["symbol"]): r["x"] for r in T.rank_to_normal(df, "x").collect()}
    assert got[D0, "A"] == got[D0, "B"] < got[D0, "C"]
    assert got[stamp(1), "A"] is None


def test_two_categories_match_dense_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    n = 60
    ind, sty = rng.integers(0, 5, n), rng.integers(0, 3, n)
    cap, y = rng.uniform(1, 100, n), rng.normal(size=n)
    df = frame(spark, [(D0, f"s{i:02d}", float(y[i]), f"i{ind[i]}", f"t{sty[i]}", float(cap[i]))
                       for i in range(n)], ["ts", "symbol", "x", "industry", "style", "market_cap"])
    x = np.column_stack([np.ones(n), np.log(cap), *[(ind == k).astype(float) for k in range(1, 5)],
                         *[(sty == k).astype(float) for k in range(1, 3)]])
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    got = rows(T.neutralize(df, "x", by=("industry", "style")), "symbol")
    assert [r["x"] for r in got] == pytest.approx(list(want), abs=1e-9)


def test_ema_ratio_matches_recursion(spark):
    xs = [3.0, None, 4.0, 5.5, 2.0, None, 7.0, 8.0] * 12
    df = frame(spark, [(stamp(i), "A", x) for i, x in enumerate(xs)], ["ts", "symbol", "x"])

    def ewm(span):
        q, num, den, out = 1 - 2 / (span + 1), 0.0, 0.0, []
        for x in xs:
            if x is not None:
                num, den = num * q + x, den * q + 1
            out.append(num / den)
        return out

    want = [a / b - 1 for a, b in zip(ewm(3), ewm(10))]
    got = [r["x"] for r in rows(T.ema_ratio(df, "x", fast=3, slow=10, block=8), "ts")]
    assert got == pytest.approx(want, abs=1e-12)


def test_apply_steps_errors(toy):
    with pytest.raises(KeyError):
        T.apply_steps(toy, [{"column": "vwap"}])
    with pytest.raises(KeyError):
        T.apply_steps(toy, [{"op": "nope", "column": "vwap"}])
    with pytest.raises(ValueError):
        T.register("zscore", T.zscore)


def test_trailing_is_truncation_invariant(spark):
    df = frame(spark, [(stamp(i), "A", float((i * 7) % 11)) for i in range(30)], ["ts", "symbol", "x"])
    for step in ({"op": "rolling_zscore", "window": 5}, {"op": "rolling_quantile", "window": 5},
                 {"op": "ema_ratio", "fast": 2, "slow": 5}):
        step = {**step, "column": "x", "out": "o"}
        full = [r["o"] for r in rows(T.apply_steps(df, [step]), "ts")]
        cut = df.where(F.col("ts") < F.lit(stamp(20)).cast("timestamp_ntz"))
        assert [r["o"] for r in rows(T.apply_steps(cut, [step]), "ts")] == full[:20]


# ------------------------------------------------------------------ evaluation and screening


@pytest.fixture(scope="module")
def planted(spark):
    """Factors with planted strength against the label."""
    import numpy as np

    rng = np.random.default_rng(7)
    data = []
    for t in range(40):
        y = rng.normal(size=40)
        e = rng.normal(size=(4, 40))
        strong, mid, none = 0.4 * y + e[0], 0.15 * y + e[1], e[2]
        for i in range(40):
            data.append((stamp(t), f"s{i:02d}", float(y[i]), float(strong[i]), float(mid[i]), float(none[i]),
                         float(strong[i] + 0.01 * e[3][i]), 1.0))
    return frame(spark, data, ["ts", "symbol", "y", "strong", "mid", "none", "dupe", "flat"])


def test_ic_recovers_planted_order(planted):
    s = {r["factor"]: r for r in E.ic_summary(E.ic(planted, ["strong", "mid", "none", "flat"], "y")).collect()}
    assert s["strong"]["mean"] > s["mid"]["mean"] > abs(s["none"]["mean"])
    # a constant cross-section has no correlation and does not poison the mean
    assert s["flat"]["n_periods"] == 0 and s["flat"]["mean"] == 0.0


def test_quantile_spread_is_monotone(planted):
    q = E.quantile_summary(E.bucketed(planted, "strong", "y", 5), 5, 40).first()
    assert q["monotonicity"] == pytest.approx(1.0) and q["spread_mean"] > 0


def test_newey_west_single_lag_by_hand(spark):
    ics = [0.1, 0.3, 0.2, 0.4]
    df = frame(spark, [("f", stamp(i), v, 30) for i, v in enumerate(ics)], ["factor", "ts", "ic", "n"])
    m = sum(ics) / 4
    d = [v - m for v in ics]
    lrv = sum(x * x for x in d) / 4 + 2 * 0.5 * sum(a * b for a, b in zip(d[1:], d)) / 4
    r = E.ic_summary(df, newey_west_lags=1).first()
    assert r["t_stat"] == pytest.approx(m / math.sqrt(lrv / 4))


def test_half_life_never_reached(spark):
    c = spark.createDataFrame([(1, 0.1), (5, 0.09)], "horizon int, ic double")
    assert E.half_life(c).first()["half_life"] == float("inf")
    c = spark.createDataFrame([(1, 0.1), (5, 0.06), (9, 0.02)], "horizon int, ic double")
    assert E.half_life(c).first()["half_life"] == pytest.approx(5 + 0.01 * 4 / 0.04)


def test_pool_rejects_duplicate_and_logs_it(spark, planted):
    pool = S.FactorPool()
    pool.propose_all(planted, ["strong", "dupe", "none"])
    log = {r["factor"]: r for r in pool.admission_log(spark).collect()}
    assert log["strong"]["verdict"] == "admit" and log["dupe"]["verdict"] == "reject"
    assert log["none"]["verdict"] == "admit" and pool.factors == ["strong", "none"]
    with pytest.raises(ValueError):
        pool.propose_all(planted, ["strong"])


def test_unmeasured_pair_is_rejected(planted):
    p = S.correlation_pairs(planted, ["strong", "mid"], min_names=1000)
    assert p.first()["rho"] is None
    assert S.screen(p, ["strong"], ["mid"]).first()["verdict"] == "reject"


def test_orthogonal_residual(planted):
    out = S.orthogonalize(planted, "strong", ["mid"], out="o")
    c = E.ic(out, "o", "mid", method="pearson")
    assert c.agg(F.max(F.abs("ic"))).first()[0] < 1e-9


def test_leak_canary(planted):
    V.assert_no_feature_leakage(planted, ["strong", "none"], "y")
    with pytest.raises(LeakageError):
        V.assert_no_feature_leakage(planted.withColumn("z", F.col("y") * 3), ["z"], "y")


# ------------------------------------------------------------------ splits


def test_splits_are_clean_and_purged(planted):
    for cv in (V.PurgedWalkForward(12, 5, label_horizon=3), V.CombinatorialPurgedCV(5, 2, 1, 2)):
        split = cv.split(planted)
        V.assert_no_leakage(split, label_horizon=cv.label_horizon, embargo=cv.embargo)
        with pytest.raises(LeakageError):
            V.assert_no_leakage(split, label_horizon=cv.label_horizon + 1, embargo=cv.embargo)
    with pytest.raises(ValueError):
        V.PurgedWalkForward(30, 30).split(planted)
    with pytest.raises(ValueError):
        V.PurgedWalkForward(3, 3, label_horizon=9).split(planted)


# ------------------------------------------------------------------ weights, costs, accounting


def test_constraints_hold(planted):
    c = P.Constraints(max_weight=0.05, min_weight=-0.05, max_industry=0.1)
    w = P.score_to_weight(planted.withColumn("industry", F.substring("symbol", 2, 1)), "strong", constraints=c)
    worst = w.agg(F.max(F.abs("weight"))).first()[0]
    assert worst <= 0.05 + 1e-12
    ind = w.groupBy("ts", "industry").agg(F.sum("weight").alias("n")).agg(F.max(F.abs("n"))).first()[0]
    assert ind <= 0.1 + 1e-9
    with pytest.warns(UserWarning):
        P.apply_constraints(w, P.Constraints(max_weight=0.001, min_weight=-0.001))
    with pytest.raises(ValueError):
        P.Constraints(max_weight=0.0, min_weight=0.1)


def test_costs_by_hand(spark):
    t = frame(spark, [(D0, "A", 250.0, 10.0, 1000.0, 0.02), (D0, "B", -130.0, 10.0, 0.0, 0.02)],
              ["ts", "symbol", "shares", "price", "adv", "sigma"])
    a, b = rows(B.CostModel().apply(t), "symbol")
    assert a["shares_filled"] == 200 and a["notional"] == 2000 and a["commission"] == 5.0
    assert a["stamp_duty"] == 0.0 and a["impact_permanent"] * 2 == pytest.approx(a["impact_temporary"])
    imp = 0.5 * 0.02 * math.sqrt(0.2) * 2000
    assert a["cost_total"] == pytest.approx(5 + 0.02 + imp)
    assert b["shares_filled"] == -130 and b["stamp_duty"] == pytest.approx(1.3)
    assert b["impact_temporary"] == 0.0
    day = spark.sql("SELECT timestamp_ntz'2023-08-27' AS a, timestamp_ntz'2023-08-28' AS b").select(
        B.stamp_duty_for(F.col("a")), B.stamp_duty_for(F.col("b"))).first()
    assert tuple(day) == (0.001, 0.0005)


def test_gross_accounting_by_hand(spark):
    w = frame(spark, [(stamp(k), s, x) for k in range(3) for s, x in (("A", 0.5), ("B", -0.5))],
              ["ts", "symbol", "weight"])
    px = frame(spark, [(stamp(0), "A", 10.0), (stamp(0), "B", 10.0), (stamp(1), "A", 11.0),
                       (stamp(1), "B", 10.0), (stamp(2), "A", 11.0), (stamp(2), "B", 12.0)],
               ["ts", "symbol", "vwap"])
    r = rows(G.simulate_cross_sectional(w, px, capital=100.0), "ts")
    assert [x["net_return"] for x in r] == pytest.approx([0.05, -0.1, 0.0])
    assert r[-1]["equity"] == pytest.approx(100 * 1.05 * 0.9)
    free = B.CostModel(0.0, 0.0, 0.0, 0.0, 0.0, lot_size=1)
    big = rows(G.simulate_cross_sectional(w, px, capital=1e12, costs=free), "ts")
    assert [x["net_return"] for x in big] == pytest.approx([0.05, -0.1, 0.0], abs=1e-9)


def test_leavers_close_only_when_asked(spark):
    w = frame(spark, [(stamp(0), "A", 0.5), (stamp(0), "B", 0.5), (stamp(1), "A", 0.5)], ["ts", "symbol", "weight"])
    px = frame(spark, [(stamp(k), s, 10.0) for k in (0, 1) for s in "AB"], ["ts", "symbol", "vwap"])
    m = B.CostModel()
    keep = G.simulate_trades(w, px, m, capital=1e5).where("symbol = 'B'").count()
    shut = G.simulate_trades(w, px, m, capital=1e5, close_leavers=True).where("symbol = 'B'")
    assert keep == 1 and rows(shut, "ts")[-1]["held"] == 0.0


def test_parity(spark):
    a = frame(spark, [(stamp(k), float(k + 1)) for k in range(4)], ["ts", "net_pnl"])
    assert G.parity_check(a, a).first()["passed"]
    with pytest.raises(ParityError):
        G.parity_check(a, a.withColumn("net_pnl", F.col("net_pnl") * 1.01))
    with pytest.raises(ParityError):
        G.parity_check(a, a.where("net_pnl > 1"))
    with pytest.raises(ParityError):
        G.parity_check(a, a.withColumn("ts", F.col("ts") + F.expr("interval 99 days")))


def test_covariance_is_positive_semidefinite(spark, planted):
    import numpy as np

    r = planted.select("ts", "symbol", F.col("strong").alias("ret"))
    for df in (KV.sample_covariance(r, block=16), KV.ledoit_wolf(r, block=16)):
        got = df.collect()
        names = sorted({x["symbol_i"] for x in got})
        m = np.zeros((len(names),) * 2)
        for x in got:
            i, j = names.index(x["symbol_i"]), names.index(x["symbol_j"])
            m[i, j] = m[j, i] = x["cov"]
        assert np.linalg.eigvalsh(m).min() > -1e-9
    with pytest.raises(Exception):
        KV.ledoit_wolf(r.where("NOT (symbol = 's00' AND ret > 0)")).collect()


# ------------------------------------------------------------------ market rules


def test_slot_counts(spark):
    ses = spark.sql("SELECT DATE'2024-01-02' AS date")
    assert C.slot_grid(ses, 60).count() == 120 + 117 + 1
    assert C.slot_grid(ses, 3).count() == 2400 + 2340 + 1
    first = rows(C.slot_grid(ses, 60), "ts")
    assert first[0]["ts"] == dt.datetime(2024, 1, 2, 9, 31) and first[-1]["ts"].hour == 15
    with pytest.raises(ValueError):
        C.slot_grid(ses, 7 * 60)
    assert [s.seconds_per_day for s in C.SPECS] == [14220, 14400, 15300, 20700]


def test_limit_band(spark):
    df = spark.createDataFrame([("688001", False), ("300001", True), ("830001", False), ("600001", True),
                                ("000001", False)], "symbol string, st boolean")
    got = [r[0] for r in df.select(M.limit_pct(F.col("symbol"), F.col("st"))).collect()]
    assert got == [0.20, 0.20, 0.30, 0.05, 0.10]


def test_short_sample_is_not_all_newly_listed(spark):
    df = frame(spark, [(stamp(k), "600000", 10.0, 10.0, 10.0, 10.0, 9.9, 5.0) for k in range(5)],
               ["ts", "symbol", "open", "high", "low", "close", "prev_close", "volume"])
    m = M.build_masks(df)
    assert m.where("newly_listed").count() == 0
    unknown = df.withColumn("symbol", F.lit("600001"))
    assert M.apply_masks(unknown, m, columns=["close"]).where("close IS NOT NULL").count() == 0


def test_split_is_not_a_return(spark):
    bars = frame(spark, [(stamp(0), "A", 10.0, 100.0), (stamp(1), "A", 5.0, 200.0)], ["ts", "symbol", "close", "volume"])
    act = frame(spark, [(stamp(1), "A", 10.0, 1.0)], ["ts", "symbol", "prev_close", "split_ratio"])
    r = rows(A.adjust(bars, A.event_factors(act)), "ts")
    assert r[1]["close"] == pytest.approx(10.0) and r[1]["close_raw"] == 5.0 and r[1]["volume"] == 100.0
    # an ex-date without a bar is lost on the grid unless it is carried to the next one
    gap = frame(spark, [(stamp(2), "A", 5.0, 1.0), (stamp(0), "A", 10.0, 1.0)], ["ts", "symbol", "close", "volume"])
    ev = A.event_factors(act)
    plain = rows(A.cumulative_factors(ev, gap), "ts")[-1]["adj_factor"]
    kept = rows(A.cumulative_factors(ev, gap, carry_missed=True), "ts")[-1]["adj_factor"]
    assert (plain, kept) == (1.0, 2.0)


def test_universe_guards(spark, toy):
    with pytest.raises(UniverseError):
        U.universe(toy, "all")
    with pytest.raises(UniverseError):
        U.universe(toy, "X")
    mem = spark.createDataFrame([("X", "A", dt.date(2024, 1, 2), dt.date(2024, 1, 4))],
                                "index_code string, symbol string, start_date date, end_date date")
    assert [r["ts"] for r in rows(U.universe(toy, "X", membership=mem), "ts")] == [stamp(1), stamp(2)]
    with pytest.raises(UniverseError):
        U.universe_at("2030-01-01", "X", membership=mem)
    with pytest.raises(Exception):
        U.members_at(mem.withColumn("start_date", F.lit(None).cast("date")), "2024-01-02").collect()


def test_rebase_adjustment_defaults_to_one(spark):
    df = frame(spark, [(stamp(0), "A", 10.0, None), (stamp(1), "A", 10.0, 5.0), (stamp(2), "A", 10.0, 6.0)],
               ["ts", "symbol", "close", "qfq"])
    assert [r["adj_factor"] for r in rows(PR.rebase_adjustment(df), "ts")] == [1.0, 1.0, 1.2]


# ------------------------------------------------------------------ raw events


def test_every_price_survives_the_vendor_float(spark):
    px = spark.range(100, 200_000).select(F.col("id"), (F.col("id") / 100).alias("p"))
    bad = px.where(K.from_vendor_price(F.col("p"), F.lit("XSHE")) != F.col("id") * 100).count()
    lossy = px.where(K.truncates_low(F.col("p"), F.lit("XSHE"))).count()
    assert bad == 0 and 0 < lossy < 199_900 * 0.1


def test_gaps_need_both_streams(spark):
    def s(nums):
        return spark.createDataFrame([(1, n) for n in nums], "channel_id bigint, seq_id bigint")

    odd, even = s(range(1, 20, 2)), s(range(2, 21, 2))
    assert TA.sequence_gaps([odd, even]).count() == 0
    assert TA.sequence_gaps(odd).count() == 9
    wide = s([3, 4, 10, 2_500_000, 2_500_001])
    got = [(r["first_missing"], r["last_missing"]) for r in rows(TA.sequence_gaps(wide), "first_missing")]
    assert got == [(1, 2), (5, 9), (11, 2_499_999)]


def _event(seq, kind, price=0.0, qty=0, side="buy", key=0, buy=0, sell=0, ts=0):
    return (1, seq, ts, "A", "XSHG", kind, float(price), qty, side, key, buy, sell)


def test_book_by_hand(spark):
    ev = [_event(1, "add", 10, 100, "buy", 1), _event(2, "add", 11, 50, "sell", 2),
          _event(3, "add", 0, 70, "buy", 3), _event(4, "cancel", qty=30, key=1),
          _event(5, "trade", 11, 50, "buy", 0, 1, 2, ts=5), _event(6, "cancel", qty=0, key=99, ts=15),
          _event(7, "cancel", qty=0, key=1, ts=25), _event(8, "trade", 10, 5, "sell", 0, 1, 0, ts=35)]
    df = spark.createDataFrame(ev, "channel_id bigint, seq_id bigint, arrival_ts bigint, symbol string, "
                                   "exchange string, kind string, price double, qty bigint, side string, "
                                   "key bigint, buy_key bigint, sell_key bigint")
    r = rows(BK.book_snapshots(df, 10), "slot")
    assert [x["slot"] for x in r] == [10, 20, 40]
    assert (r[0]["best_bid"], r[0]["bid_qty"], r[0]["best_ask"], r[0]["slot_trades"]) == (10.0, 20, 0.0, 1)
    assert r[0]["spread"] is None and r[0]["imbalance_l1"] == 1.0
    assert (r[1]["unresolved"], r[1]["bid_qty"]) == (1, 20)
    # the emptied book shows again because of the trade, whose reference is already gone
    assert (r[2]["n_bid_orders"], r[2]["slot_qty"], r[2]["unresolved"]) == (0, 5, 2)


def test_boundary_record_opens_the_next_slot(spark):
    got = spark.range(1).select(K.right_label(F.lit(30), 10), K.right_label(F.lit(29), 10)).first()
    assert tuple(got) == (40, 30)


# ------------------------------------------------------------------ schema contract


def test_fingerprint_contract():
    a = ST.Fingerprint.of([ST.FactorSpec("x", {"n": 5, "m": 1}), "y"], "p")
    a.validate(ST.Fingerprint.of([ST.FactorSpec("x", {"m": 1, "n": 5}), "y"], "p"))
    for other in (ST.Fingerprint.of(["y", ST.FactorSpec("x", {"n": 5, "m": 1})], "p"),
                  ST.Fingerprint.of([ST.FactorSpec("x", {"n": 6, "m": 1}), "y"], "p"),
                  ST.Fingerprint.of([ST.FactorSpec("x", {"n": 5, "m": 1}), "y"], "q")):
        with pytest.raises(SchemaMismatch):
            a.validate(other)
    assert ST.Fingerprint.from_json(a.to_json()) == a
    with pytest.raises(SchemaMismatch):
        ST.Fingerprint.from_json(a.to_json().replace('"n": 5', '"n": 7'))


def test_pruning_reaches_the_scan(spark, tmp_path):
    df = frame(spark, [(stamp(k), s, 1.0 * k) for k in range(4) for s in ("000001", "000002")], ["ts", "symbol", "x"])
    ST.write_partitioned(df, f"{tmp_path}/daily", by_symbol=True)
    root = ST.DataRoot(spark, str(tmp_path))
    assert root.available() == ["daily"] and root.hive_keys("daily") == ("date", "symbol")
    got = ST.load_daily(root.read("daily"), ["x"], dates=[stamp(1)], symbols=["000002"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "20240102" in plan.split("PartitionFilters")[1]
    assert [(r["symbol"], r["x"]) for r in got.collect()] == [("000002", 1.0)]
    with pytest.raises(KeyError):
        ST.load_daily(root.read("daily"), ["nope"])
    with pytest.raises(ValueError):
        ST.load_ticks(root.read("daily"), stamp(1))
    with pytest.raises(ValueError):
        ST.prune(symbols=[])
