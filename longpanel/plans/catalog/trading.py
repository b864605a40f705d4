"""Queries for weights, hedges, costs, accounting and covariance."""

from pyspark.sql import functions as F

from ...functions.columns import ratio

from ...operators import accounting as G
from ...operators import costs as B
from ...operators import covariance as K
from ...operators import metrics as M
from ...operators import portfolio as P
from ...plans.studies import frequency_sweep
from ...sources.panels import return_series, weekly_panel
from .base import SERIES, Catalog, panel_sql, r, rounded

CATALOG = Catalog()
add = CATALOG.add

_RK = """,
rk AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY vwap) + (count(*) OVER (PARTITION BY ts, vwap) - 1) / 2.0 AS rr,
  count(*) OVER (PARTITION BY ts) AS n FROM panel)"""
_W_RANK = f"""{_RK},
w0 AS (SELECT *, rr - avg(rr) OVER (PARTITION BY ts) AS raw FROM rk),
wt AS (SELECT ts, symbol, industry, vwap, volume, CASE WHEN sum(abs(raw)) OVER (PARTITION BY ts) > 0
  THEN raw / sum(abs(raw)) OVER (PARTITION BY ts) ELSE 0 END AS weight FROM w0)"""


def _weights(spark, d, **kw):
    p = weekly_panel(spark, d).withColumn("score", F.col("vwap"))
    return P.score_to_weight(p, "score", **kw)


@add("weight_rank", f"WITH {panel_sql()} {_W_RANK} SELECT ts, symbol, {r('weight', 'weight', 10)} FROM wt")
def weight_rank(spark, d):
    return rounded(_weights(spark, d).select("ts", "symbol", "weight"), 10)


@add("weight_equal", f"""WITH {panel_sql()} {_RK},
w0 AS (SELECT *, CASE WHEN rr / n > 1 - 0.2 THEN 1.0 WHEN rr / n <= 0.2 THEN -1.0 ELSE 0.0 END AS raw FROM rk)
SELECT ts, symbol, {r('''CASE WHEN sum(abs(raw)) OVER (PARTITION BY ts) > 0
  THEN raw / sum(abs(raw)) OVER (PARTITION BY ts) ELSE 0 END''', 'weight', 10)} FROM w0""")
def weight_equal(spark, d):
    return rounded(_weights(spark, d, method="equal").select("ts", "symbol", "weight"), 10)


@add("weight_score", f"""WITH {panel_sql()},
w0 AS (SELECT *, vwap - avg(vwap) OVER (PARTITION BY ts) AS raw FROM panel)
SELECT ts, symbol, {r('''CASE WHEN sum(abs(raw)) OVER (PARTITION BY ts) > 0
  THEN raw / sum(abs(raw)) OVER (PARTITION BY ts) ELSE 0 END''', 'weight', 10)} FROM w0""")
def weight_score(spark, d):
    return rounded(_weights(spark, d, method="score").select("ts", "symbol", "weight"), 10)


# the projection, stated step by step and carried on for as many rounds as the operator may take
def _projected(cap, rounds=50):
    return f""",
rd AS (SELECT 0 AS k, ts, symbol, industry, weight AS w FROM wt
UNION ALL SELECT k + 1, ts, symbol, industry, least(greatest(w3, -0.03), 0.03) FROM (
  SELECT *, CASE WHEN abs(sum(w2) OVER (PARTITION BY ts, industry)) > {cap} THEN w2 * {cap} / abs(sum(w2) OVER (PARTITION BY ts, industry)) ELSE w2 END AS w3 FROM (
  SELECT *, CASE WHEN abs(sum(w1) OVER (PARTITION BY ts)) > 1e-12 THEN w1 - sum(w1) OVER (PARTITION BY ts) / count(*) OVER (PARTITION BY ts) ELSE w1 END AS w2 FROM (
  SELECT *, CASE WHEN sum(abs(w)) OVER (PARTITION BY ts) > 0 THEN w / sum(abs(w)) OVER (PARTITION BY ts) ELSE w END AS w1 FROM rd WHERE k < {rounds}))))"""


@add("weight_constraints", f"""WITH RECURSIVE {panel_sql()} {_W_RANK} {_projected(0.1)}
SELECT ts, symbol, {r('w', 'weight')} FROM rd WHERE k = 50""")
def weight_constraints(spark, d):
    c = P.Constraints(max_weight=0.03, min_weight=-0.03, max_industry=0.10)
    w = P.apply_constraints(_weights(spark, d), c)
    return rounded(w.select("ts", "symbol", "weight"))


@add("weight_constraints_converged", f"""WITH RECURSIVE {panel_sql()} {_W_RANK} {_projected(0.05)}
SELECT ts, symbol, {r('w', 'weight')} FROM rd WHERE k = 50""")
def weight_converged(spark, d):
    c = P.Constraints(max_weight=0.03, min_weight=-0.03, max_industry=0.05)
    return rounded(_weights(spark, d, constraints=c).select("ts", "symbol", "weight"))


@add("weight_turnover_blend", f"""WITH RECURSIVE {panel_sql()} {_W_RANK} {_projected(0.1)},
x1 AS (SELECT ts, symbol, w FROM rd WHERE k = 50),
pv AS (SELECT x1.*, CASE WHEN l_suppkey % 2 = 0 THEN 0.011 / 3 ELSE -0.011 / 3 END AS prev FROM x1 JOIN panel USING (ts, symbol)),
tr AS (SELECT *, sum(abs(w - prev)) OVER (PARTITION BY ts) AS trade FROM pv)
SELECT ts, symbol, {r('CASE WHEN trade > 0.3 THEN prev + 0.3 / trade * (w - prev) ELSE w END', 'weight')} FROM tr""")
def weight_turnover(spark, d):
    c = P.Constraints(max_weight=0.03, min_weight=-0.03, max_industry=0.10, max_turnover=0.3)
    w = _weights(spark, d).withColumn("prev", F.when(F.col("l_suppkey") % 2 == 0, 0.011 / 3).otherwise(-0.011 / 3))
    return rounded(P.apply_constraints(w, c, prev_weight="prev").select("ts", "symbol", "weight"))


@add("weight_market_neutral", f"""WITH {panel_sql()} {_W_RANK},
g AS (SELECT ts, sum(weight * ln(volume)) AS beta FROM wt GROUP BY ts)
SELECT ts, 'IM' AS hedge, {r('beta', 'beta')}, {r('beta * 1e8', 'notional', 3)},
  CAST(round_even(-beta * 1e8 / (6000.0 * 200), 0) AS BIGINT) AS contracts,
  {r('beta * 1e8 + round_even(-beta * 1e8 / (6000.0 * 200), 0) * 6000 * 200', 'residual_notional', 3)}, CAST(200 AS DOUBLE) AS multiplier FROM g""")
def market_neutral(spark, d):
    w = _weights(spark, d).withColumn("beta", F.log("volume"))
    return rounded(P.market_neutral(w, capital=1e8, index_price=6000.0), notional=3,
                   residual_notional=3)


# ------------------------------------------------------------------ costs

_TRADES = """,
tr AS (SELECT ts, symbol, (CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END) * volume * 10 AS shares, 100 * ln(vwap) AS price,
  volume * 40 AS adv, 0.02 + l_suppkey % 7 / 100.0 AS sigma FROM panel)"""


def _trades(spark, d):
    p = weekly_panel(spark, d)
    return p.select(
        "ts", "symbol", (F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(-1) * F.col("volume") * 10)
        .alias("shares"), (100 * F.log("vwap")).alias("price"), (F.col("volume") * 40).alias("adv"),
        (0.02 + F.col("l_suppkey") % 7 / 100.0).alias("sigma"))


_COSTED = f"""{_TRADES},
fl AS (SELECT *, CASE WHEN shares > 0 THEN floor(shares / 100) * 100 ELSE shares END AS f FROM tr),
nt AS (SELECT *, abs(f) * price AS n FROM fl),
im AS (SELECT *, CASE WHEN n > 0 THEN greatest(n * 0.00025, 5.0) ELSE 0 END AS comm,
  CASE WHEN f < 0 THEN n * (CASE WHEN CAST(ts AS DATE) >= DATE '2023-08-28' THEN 0.0005 ELSE 0.001 END) ELSE 0 END AS stamp,
  n * 0.00001 AS fee, 0.5 * sigma * sqrt(least(abs(f) / adv, 1.0)) * n AS imp FROM nt)"""


@add("cost_apply", f"""WITH {panel_sql()} {_COSTED}
SELECT ts, symbol, {r('f', 'shares_filled', 4)}, {r('n', 'notional', 3)}, {r('comm', 'commission', 4)}, {r('stamp', 'stamp_duty', 4)},
  {r('fee', 'transfer_fee', 4)}, {r('imp * 2 / 3', 'impact_temporary', 4)}, {r('imp / 3', 'impact_permanent', 4)},
  {r('comm + stamp + fee + imp', 'cost_total', 4)}, {r('CASE WHEN n > 0 THEN (comm + stamp + fee + imp) / n * 1e4 ELSE 0 END', 'cost_bps', 5)} FROM im""")
def cost_apply(spark, d):
    c = B.CostModel(stamp_duty=None).apply(_trades(spark, d))
    return rounded(c.drop("shares", "price", "adv", "sigma"), 4, notional=3, cost_bps=5)


@add("cost_impact_and_lots", f"""WITH {panel_sql()} {_TRADES}
SELECT ts, symbol, {r('0.5 * sigma * sqrt(least(abs(shares) / adv, 1.0))', 'impact')},
  {r('CASE WHEN shares > 0 THEN floor(shares / 100) * 100 ELSE shares END', 'lots')},
  CASE WHEN CAST(ts AS DATE) >= DATE '2023-08-28' THEN CAST(0.0005 AS DOUBLE) ELSE 0.001 END AS duty FROM tr""")
def impact(spark, d):
    t = _trades(spark, d)
    return rounded(t.select("ts", "symbol",
                            B.square_root_impact(F.col("shares"), F.col("adv"), F.col("sigma")).alias("impact"),
                            B.round_lots(F.col("shares")).alias("lots"), B.stamp_duty_for(F.col("ts")).alias("duty")))


@add("cost_deadband", f"""WITH {panel_sql()} {_TRADES}
SELECT ts, symbol, {r('''2 * greatest(0.00025, 5.0 / (price * abs(shares))) + 2 * 0.00001 + 0.001
  + 2 * 0.5 * sigma * sqrt(least(abs(shares) / adv, 1.0))''', 'deadband')} FROM tr""")
def deadband(spark, d):
    m = B.CostModel()
    return rounded(_trades(spark, d).select("ts", "symbol", m.deadband(
        F.col("price"), F.col("shares"), F.col("adv"), F.col("sigma")).alias("deadband")))


@add("cost_inputs", f"""WITH {panel_sql()},
w AS (SELECT ts, symbol, count(amount) OVER q AS n, avg(amount) OVER q AS a, last_value(CASE WHEN volume > 100 THEN vwap END IGNORE NULLS)
  OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vwap FROM panel
  WINDOW q AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT ts, symbol, {r('CASE WHEN n >= 5 THEN ln(a) END', 'adv')}, CAST(0.02 AS DOUBLE) AS sigma, {r('ln(vwap)', 'vwap')} FROM w""")
def cost_inputs(spark, d):
    p = weekly_panel(spark, d).withColumn("vwap", F.when(F.col("volume") > 100, F.col("vwap")))
    t = B.trading_inputs(p)
    return rounded(t.select("ts", "symbol", F.log("adv").alias("adv"), "sigma", F.log("vwap").alias("vwap")))


@add("cost_attribution", f"""WITH {panel_sql()} {_COSTED}
SELECT component, round(total, 2) AS total FROM (SELECT 'commission' AS component, sum(comm) AS total FROM im
  UNION ALL SELECT 'stamp_duty', sum(stamp) FROM im UNION ALL SELECT 'transfer_fee', sum(fee) FROM im
  UNION ALL SELECT 'impact_temporary', sum(imp * 2 / 3) FROM im UNION ALL SELECT 'impact_permanent', sum(imp / 3) FROM im)""")
def attribution(spark, d):
    return rounded(M.cost_attribution(B.CostModel(stamp_duty=None).apply(_trades(spark, d))), 2)


@add("weight_mean_by_industry", f"""WITH {panel_sql()} {_W_RANK}
SELECT industry, {r('avg(weight)', 'mean_weight')} FROM wt GROUP BY industry""")
def mean_weight(spark, d):
    return rounded(M.mean_weight_by(_weights(spark, d)))


# ------------------------------------------------------------------ accounting

# log prices and a tenth of the gross keep compounded equity within range on this panel
_PX = ", px AS (SELECT ts, symbol, ln(vwap) AS p FROM panel)"
_GROSS = f"""{_PX},
o AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k FROM (SELECT DISTINCT ts FROM wt)),
b AS (SELECT wt.ts, wt.symbol, weight * 0.1 AS w, p, k FROM wt JOIN px ON px.ts = wt.ts AND px.symbol = wt.symbol JOIN o ON o.ts = wt.ts),
pr AS (SELECT c.*, l.w AS lw, l.p AS lp FROM b c LEFT JOIN b l ON l.symbol = c.symbol AND l.k = c.k - 1),
gr AS (SELECT k - 1 AS k, sum(lw * (p / lp - 1)) AS g FROM pr WHERE lw IS NOT NULL GROUP BY k),
pt AS (SELECT o.ts, o.k, coalesce(g, 0) AS g, 1e6 * product(1 + coalesce(g, 0)) OVER (ORDER BY o.k) AS eq FROM o LEFT JOIN gr ON gr.k = o.k),
pb AS (SELECT *, coalesce(lag(eq) OVER (ORDER BY k), 1e6) AS e0 FROM pt),
tv AS (SELECT pr.k, sum(abs(pr.w * n.e0 - coalesce(pr.lw * m.e0 * pr.p / pr.lp, 0))) / max(n.eq) AS turnover,
  sum(abs(pr.w * n.e0)) / max(n.eq) AS ge, sum(pr.w * n.e0) / max(n.eq) AS ne, count(*) FILTER (WHERE abs(pr.w) > 0) AS nn
  FROM pr JOIN pb n ON n.k = pr.k LEFT JOIN pb m ON m.k = pr.k - 1 GROUP BY pr.k)"""


@add("account_gross", f"""WITH {panel_sql()} {_W_RANK} {_GROSS}
SELECT 'book' AS book_id, ts, {r('g * e0', 'gross_pnl', 4)}, CAST(0 AS DOUBLE) AS cost, {r('g * e0', 'net_pnl', 4)}, {r('g', 'net_return')},
  {r('turnover', 'turnover')}, {r('ge', 'gross_exposure')}, {r('ne', 'net_exposure')}, {r('eq', 'equity', 4)}, nn AS n_names
FROM pb JOIN tv USING (k)""")
def gross(spark, d):
    w, px = _costed_inputs(spark, d)
    return rounded(G.simulate_cross_sectional(w, px, capital=1e6), gross_pnl=4, net_pnl=4, equity=4)


def _costed_inputs(spark, d):
    p = weekly_panel(spark, d)
    w = _weights(spark, d).withColumn("weight", F.col("weight") * 0.1)
    px = p.select("ts", "symbol", F.log("vwap").alias("vwap"), (F.col("volume") * 1000).alias("adv"),
                  F.lit(0.02).alias("sigma"))
    return w, px


@add("account_costed")
def costed(spark, d):
    w, px = _costed_inputs(spark, d)
    return rounded(G.simulate_cross_sectional(w, px, capital=1e6, costs=B.CostModel()), 4)


@add("account_costed_trades")
def costed_trades(spark, d):
    w, px = _costed_inputs(spark, d)
    return rounded(G.simulate_trades(w, px, B.CostModel(), capital=1e6, close_leavers=True), 4)


# a model that charges nothing and trades single shares must agree with the closed form
@add("account_costed_free", f"""WITH {panel_sql()} {_W_RANK} {_GROSS}
SELECT ts, {r('g', 'net_return')}, {r('turnover', 'turnover', 6)} FROM pb JOIN tv USING (k)""")
def costed_free(spark, d):
    w, px = _costed_inputs(spark, d)
    # capital so large that rounding buys to one share is below the reported digits
    free = B.CostModel(0.0, 0.0, 0.0, 0.0, 0.0, lot_size=1)
    out = G.simulate_cross_sectional(w, px, capital=1e15, costs=free)
    return rounded(out.select("ts", "net_return", "turnover"), turnover=6)


@add("account_book_summary", f"""WITH {panel_sql()} {_W_RANK} {_GROSS}
SELECT 'book' AS book_id, CAST(0 AS DOUBLE) AS total_cost, CAST(0 AS DOUBLE) AS cost_drag_bps, {r('sum(g)', 'net_return')},
  count(*) AS n_periods FROM pb""")
def book_summary(spark, d):
    w, px = _costed_inputs(spark, d)
    return rounded(G.book_summary(G.simulate_cross_sectional(w, px, capital=1e6), 1e6))


_TS = """,
sg AS (SELECT ts, symbol, CASE WHEN close > open THEN 3.0 WHEN close < open THEN -2.0 ELSE 0.0 END AS pos, 1000 * ln(close) AS px, ln(high / low) * 100 AS spread FROM panel),
sn AS (SELECT *, coalesce(lead(px) OVER s, px) AS nx, pos - coalesce(lag(pos) OVER s, 0) AS delta FROM sg WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
sc AS (SELECT *, pos * (nx - px) AS gross, CASE WHEN abs(delta) * nx > 0 THEN greatest(abs(delta) * nx * 0.00025, 5.0) ELSE 0 END
  + CASE WHEN delta < 0 THEN abs(delta) * nx * 0.001 ELSE 0 END AS cost FROM sn)"""


def _signal(spark, d):
    p = weekly_panel(spark, d)
    s = F.when(F.col("close") > F.col("open"), 3.0).when(F.col("close") < F.col("open"), -2.0).otherwise(0.0)
    return p.select("ts", "symbol", s.alias("signal"), (1000 * F.log("close")).alias("close"),
                    (F.log(F.col("high") / F.col("low")) * 100).alias("spread"))


@add("account_time_series", f"""WITH {panel_sql()} {_TS}
SELECT ts, symbol, {r('pos', 'position')}, {r('gross', 'gross_pnl', 3)}, {r('cost', 'cost', 3)}, {r('gross - cost', 'net_pnl', 3)},
  {r('sum(gross - cost) OVER (PARTITION BY symbol ORDER BY ts)', 'equity', 3)} FROM sc""")
def time_series(spark, d):
    out = G.simulate_time_series(_signal(spark, d), costs=B.CostModel())
    return rounded(out.select("ts", "symbol", "position", "gross_pnl", "cost", "net_pnl", "equity"), 3)


@add("account_fill_sensitivity", f"""WITH {panel_sql()} {_TS},
a AS (SELECT symbol, sum(abs(delta) * spread / 2) AS pen, abs(sum(gross - cost)) AS tot, count(*) FILTER (WHERE delta <> 0) AS n_trades FROM sc GROUP BY symbol)
SELECT symbol, {r('least(pen / tot, 1.0)', 'fill_sensitivity')}, n_trades, least(pen / tot, 1.0) > 0.5 AS is_fill_dominated FROM a""")
def fill_sensitivity(spark, d):
    return rounded(G.fill_sensitivity(G.simulate_time_series(_signal(spark, d), costs=B.CostModel())))


@add("account_parity_report", f"""WITH {panel_sql()} {_W_RANK} {_GROSS},
x AS (SELECT ts, g * e0 AS a, g * e0 * (CASE WHEN k % 50 = 7 THEN 1 + k * 1e-6 ELSE 1 END) AS b FROM pb),
y AS (SELECT x.*, abs(a - b) AS ad, CASE WHEN abs(b) > 0 THEN abs(a - b) / abs(b) ELSE abs(a - b) END AS rd FROM x WHERE ts < TIMESTAMP '2001-01-01')
SELECT count(*) AS n_periods, CAST((SELECT count(*) FROM x) - count(*) AS BIGINT) AS n_missing, {r('max(ad)', 'max_abs_diff', 4)}, {r('max(rd)', 'max_rel_diff', 8)},
  {r('sum(a)', 'total_a', 3)}, {r('sum(b)', 'total_b', 3)}, arg_max(ts, rd) AS worst_period, false AS passed FROM y""")
def parity(spark, d):
    w, px = _costed_inputs(spark, d)
    a = G.simulate_cross_sectional(w, px, capital=1e6).select("ts", "net_pnl")
    from ...functions.ordered import with_ordinal
    b = with_ordinal(a, "ts", "k").select("ts", (F.col("net_pnl") * F.when(
        (F.col("k") + 1) % 50 == 7, 1 + (F.col("k") + 1) * 1e-6).otherwise(1.0)).alias("net_pnl"))
    b = b.where(F.col("ts") < F.lit("2001-01-01").cast("timestamp_ntz"))
    return rounded(G.parity_report(a, b), 8, max_abs_diff=4, total_a=3, total_b=3)


@add("account_frequency_sweep")
def sweep(spark, d):
    p = weekly_panel(spark, d)
    preds = p.select("ts", "symbol", (-F.col("log_volume")).alias("pred"))
    _, px = _costed_inputs(spark, d)
    return rounded(frequency_sweep(preds, px, (1, 2, 5, 10), costs=B.CostModel(), capital=1e6, ppy=52.0), 4)


# ------------------------------------------------------------------ covariance

_ROWRET = """,
rr AS (SELECT ts, symbol, close / prev_close - 1 AS ret FROM panel WHERE prev_close IS NOT NULL)"""


def _rowret(spark, d):
    p = weekly_panel(spark, d)
    return p.where(F.col("prev_close").isNotNull()).select(
        "ts", "symbol", (ratio(F.col("close"), F.col("prev_close")) - 1).alias("ret"))


@add("cov_sample", f"""WITH {panel_sql()} {_ROWRET}
SELECT a.symbol AS symbol_i, b.symbol AS symbol_j, count(*) AS n, {r('covar_samp(a.ret, b.ret)', 'cov', 6)}
FROM rr a JOIN rr b ON a.ts = b.ts AND a.symbol <= b.symbol GROUP BY ALL""")
def cov_sample(spark, d):
    return rounded(K.sample_covariance(_rowret(spark, d), block=32, slice_len=100), 6)


# weeks in which every industry has a return make a complete panel
_FULL = """,
fu AS (SELECT series AS symbol, ts, ret FROM series WHERE ts IN (SELECT ts FROM series GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT series) FROM series)))"""


def _complete(spark, d):
    s = return_series(spark, d).select(F.col("series").alias("symbol"), "ts", "ret")
    n = s.agg(F.count_distinct("symbol").alias("n")).first()["n"]
    full = s.groupBy("ts").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == n).select("ts")
    return s.join(full, "ts", "left_semi")


_LW = """,
de AS (SELECT symbol, ts, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM fu),
tt AS (SELECT count(DISTINCT ts) AS t FROM fu),
pm AS (SELECT a.symbol AS i, b.symbol AS j, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS s22, avg(a.x * a.x * a.x * b.x) AS s31
  FROM de a JOIN de b ON a.ts = b.ts GROUP BY ALL),
dg AS (SELECT i, s AS v FROM pm WHERE i = j),
al AS (SELECT pm.*, x.v AS vi, y.v AS vj, sqrt(x.v) * sqrt(y.v) AS sd FROM pm JOIN dg x ON x.i = pm.i JOIN dg y ON y.i = pm.j),
rb AS (SELECT avg(s / sd) AS rbar FROM al WHERE i <> j),
tg AS (SELECT al.*, rbar, CASE WHEN i = j THEN s ELSE rbar * sd END AS f, s22 - s * s AS phi,
  CASE WHEN i = j THEN 0 ELSE sqrt(vi) / sqrt(vj) * (s31 - vi * s) END AS th FROM al, rb),
sm AS (SELECT sum(phi) AS pi, sum((s - f) * (s - f)) AS gam, sum(CASE WHEN i = j THEN phi ELSE 0 END) + max(rbar) * sum(th) AS rho FROM tg),
ky AS (SELECT least(greatest((pi - rho) / gam / t, 0), 1) AS k FROM sm, tt)"""


@add("cov_ledoit_wolf", f"""WITH {panel_sql()} {SERIES} {_FULL} {_LW}
SELECT i AS symbol_i, j AS symbol_j, {r('k * f + (1 - k) * s', 'cov', 6)}, {r('k', 'intensity', 6)} FROM tg, ky WHERE i <= j""")
def cov_lw(spark, d):
    return rounded(K.ledoit_wolf(_complete(spark, d), block=8), 6)


_EXPO = """,
ex AS (SELECT DISTINCT symbol, CAST(1 AS DOUBLE) AS e0, CAST(substring(symbol, 8) AS DOUBLE) / 25 AS e1 FROM fu),
gm AS (SELECT sum(e0*e0) AS a, sum(e0*e1) AS b, sum(e1*e1) AS c FROM ex),
ld AS (SELECT symbol, e0, e1, (c * e0 - b * e1) / (a * c - b * b) AS l0, (a * e1 - b * e0) / (a * c - b * b) AS l1 FROM ex, gm),
fr AS (SELECT ts, sum(l0 * ret) AS f0, sum(l1 * ret) AS f1 FROM fu JOIN ld USING (symbol) GROUP BY ts),
fc AS (SELECT covar_samp(f0, f0) AS c00, covar_samp(f0, f1) AS c01, covar_samp(f1, f1) AS c11 FROM fr),
sv AS (SELECT symbol, max(e0) AS e0, max(e1) AS e1, greatest(var_samp(ret - e0 * f0 - e1 * f1), 1e-8) AS dd FROM fu JOIN ld USING (symbol) JOIN fr USING (ts) GROUP BY symbol)"""


def _exposures(df):
    return df.select("symbol").distinct().select(
        "symbol", F.lit(1.0).alias("e0"), (F.substring("symbol", 8, 9).cast("double") / 25).alias("e1"))


@add("cov_factor_model", f"""WITH {panel_sql()} {SERIES} {_FULL} {_EXPO}
SELECT x.symbol AS symbol_i, y.symbol AS symbol_j, {r('''x.e0 * y.e0 * c00 + (x.e0 * y.e1 + x.e1 * y.e0) * c01 + x.e1 * y.e1 * c11
  + CASE WHEN x.symbol = y.symbol THEN x.dd ELSE 0 END''', 'cov', 6)} FROM sv x JOIN sv y ON x.symbol <= y.symbol, fc""")
def cov_factor(spark, d):
    s = _complete(spark, d)
    return rounded(K.factor_covariance(s, _exposures(s), ["e0", "e1"], block=8), 6)


@add("cov_factor_returns", f"""WITH {panel_sql()} {SERIES} {_FULL} {_EXPO}
SELECT ts, {r('f0', 'e0')}, {r('f1', 'e1')} FROM fr""")
def factor_returns(spark, d):
    s = _complete(spark, d)
    return rounded(K.factor_returns(s, _exposures(s), ["e0", "e1"]))
