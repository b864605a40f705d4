"""Queries for cross-sectional and trailing transforms."""

from pyspark.sql import functions as F

from ...functions import normal
from ...functions.columns import clean_non_finite, ratio
from ...operators import transforms as T
from ...operators.portfolio import combine_scores, equal_weight_composite
from ...sources.panels import panel, weekly_panel
from .base import Catalog, avg_rank, panel_sql, r, rounded

CATALOG = Catalog()
add = CATALOG.add


@add("transform_winsorize_mad", f"""WITH {panel_sql()}, lp AS (SELECT ts, symbol, ln(vwap) AS v FROM panel),
a AS (SELECT *, median(v) OVER (PARTITION BY ts) AS med FROM lp),
b AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY ts) * 1.4826 AS mad FROM a)
SELECT ts, symbol, {r('''CASE WHEN mad > 0 THEN least(greatest(v, med - 1.0 * mad), med + 1.0 * mad)
  ELSE v END''', 'x')} FROM b""")
def winsorize_mad(spark, d):
    p = weekly_panel(spark, d).select("ts", "symbol", F.log("vwap").alias("x"))
    return rounded(T.winsorize(p, "x", k=1.0))


@add("transform_winsorize_quantile", f"""WITH {panel_sql()}, lp AS (SELECT ts, symbol, ln(vwap) AS v FROM panel),
a AS (SELECT *, quantile_cont(v, 0.05) OVER (PARTITION BY ts) AS lo,
  quantile_cont(v, 0.95) OVER (PARTITION BY ts) AS hi FROM lp)
SELECT ts, symbol, {r('''CASE WHEN hi > lo THEN least(greatest(v, lo), hi) ELSE v END''', 'x')}
FROM a""")
def winsorize_quantile(spark, d):
    p = weekly_panel(spark, d).select("ts", "symbol", F.log("vwap").alias("x"))
    return rounded(T.winsorize(p, "x", method="quantile", lower=0.05, upper=0.95,
                               interpolation="linear"))


@add("transform_winsorize_nearest", f"""WITH {panel_sql()}, lp AS (SELECT ts, symbol, ln(vwap) AS v FROM panel),
a AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY v) - 1 AS k,
  count(*) OVER (PARTITION BY ts) AS n FROM lp),
b AS (SELECT ts, max(v) FILTER (WHERE k = CAST(floor(0.1 * (n - 1) + 0.5) AS BIGINT)) AS lo,
  max(v) FILTER (WHERE k = CAST(floor(0.9 * (n - 1) + 0.5) AS BIGINT)) AS hi FROM a GROUP BY ts)
SELECT lp.ts, symbol, {r('''CASE WHEN hi > lo THEN least(greatest(v, lo), hi) ELSE v END''', 'x')}
FROM lp JOIN b ON b.ts = lp.ts""")
def winsorize_nearest(spark, d):
    p = weekly_panel(spark, d).select("ts", "symbol", F.log("vwap").alias("x"))
    return rounded(T.winsorize(p, "x", method="quantile", lower=0.1, upper=0.9))


@add("transform_zscore", f"""WITH {panel_sql()},
a AS (SELECT *, avg(vwap) OVER (PARTITION BY ts) AS mu, stddev_samp(vwap) OVER (PARTITION BY ts) AS s1,
  stddev_pop(vwap) OVER (PARTITION BY ts) AS s0 FROM panel)
SELECT ts, symbol, {r('CASE WHEN s1 > 0 THEN (vwap - mu) / s1 END', 'z1')},
  {r('CASE WHEN s0 > 0 THEN (vwap - mu) / s0 END', 'z0')} FROM a""")
def zscore(spark, d):
    p = weekly_panel(spark, d).select("ts", "symbol", "vwap")
    p = T.zscore(T.zscore(p, "vwap", out="z1"), "vwap", out="z0", ddof=0)
    return rounded(p.select("ts", "symbol", "z1", "z0"))


def _poly(c, x):
    out = repr(c[-1])
    for k in reversed(c[:-1]):
        out = f"({out} * {x} + {k!r})"
    return out


_Q = "(pp - 0.5)"
_R0 = f"(0.180625 - {_Q} * {_Q})"
_INV = f"""CASE WHEN abs({_Q}) <= 0.425 THEN {_Q} * {_poly(normal.A, _R0)} / {_poly(normal.B, _R0)}
ELSE sign({_Q}) * CASE WHEN tl <= 5 THEN {_poly(normal.C, '(tl - 1.6)')} / {_poly(normal.D, '(tl - 1.6)')}
  ELSE {_poly(normal.E, '(tl - 5.0)')} / {_poly(normal.G, '(tl - 5.0)')} END END"""


@add("transform_rank_to_normal", f"""WITH {panel_sql()},
a AS (SELECT ts, symbol, {avg_rank('vwap', 'ts')} AS rk, count(vwap) OVER (PARTITION BY ts) AS n FROM panel),
b AS (SELECT *, greatest(1e-9, least((rk - 0.375) / (n + 0.25), 1 - 1e-9)) AS pp FROM a WHERE n > 1),
c AS (SELECT *, sqrt(-ln(least(pp, 1 - pp))) AS tl FROM b)
SELECT a.ts, a.symbol, {r(_INV, 'x')} FROM a LEFT JOIN c ON c.ts = a.ts AND c.symbol = a.symbol""")
def rank_to_normal(spark, d):
    p = weekly_panel(spark, d).select("ts", "symbol", F.col("vwap").alias("x"))
    return rounded(T.rank_to_normal(p, "x"))


@add("transform_neutralize", f"""WITH {panel_sql()},
v AS (SELECT ts, symbol, industry, ln(vwap) AS y, ln(market_cap) AS x FROM panel WHERE market_cap > 0),
dm AS (SELECT *, y - avg(y) OVER (PARTITION BY ts, industry) AS yd,
  x - avg(x) OVER (PARTITION BY ts, industry) AS xd FROM v),
sl AS (SELECT *, sum(xd * yd) OVER (PARTITION BY ts) / nullif(sum(xd * xd) OVER (PARTITION BY ts), 0) AS b,
  count(*) OVER (PARTITION BY ts) AS n FROM dm)
SELECT p.ts, p.symbol, {r('CASE WHEN n >= 10 THEN yd - coalesce(b, 0) * xd END', 'x', 6)}
FROM panel p LEFT JOIN sl ON sl.ts = p.ts AND sl.symbol = p.symbol""")
def neutralize(spark, d):
    p = weekly_panel(spark, d).withColumn("x", F.log("vwap"))
    return rounded(T.neutralize(p, "x").select("ts", "symbol", "x"), 6)


@add("transform_neutralize_size_only", f"""WITH {panel_sql()},
v AS (SELECT ts, symbol, ln(vwap) AS y, ln(market_cap) AS x FROM panel WHERE market_cap > 0),
f AS (SELECT ts, regr_slope(y, x) AS b, avg(y) AS my, avg(x) AS mx, count(*) AS n FROM v GROUP BY ts)
SELECT p.ts, p.symbol, {r('CASE WHEN n >= 10 THEN y - my - b * (x - mx) END', 'x', 6)}
FROM panel p LEFT JOIN v ON v.ts = p.ts AND v.symbol = p.symbol LEFT JOIN f ON f.ts = p.ts""")
def neutralize_size(spark, d):
    p = weekly_panel(spark, d).withColumn("x", F.log("vwap"))
    return rounded(T.neutralize(p, "x", by=()).select("ts", "symbol", "x"), 6)


@add("transform_neutralize_two_categories")
def neutralize_two(spark, d):
    p = weekly_panel(spark, d).withColumns({
        "x": F.log("vwap"), "style": (F.col("l_suppkey") % 3).cast("string")})
    return rounded(T.neutralize(p, "x", by=("industry", "style")).select("ts", "symbol", "x"), 6)


@add("transform_rolling_zscore", f"""WITH {panel_sql()},
a AS (SELECT ts, symbol, vwap, avg(vwap) OVER w AS mu, stddev_samp(vwap) OVER w AS sd, count(vwap) OVER w AS n
  FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT ts, symbol, {r('CASE WHEN n >= 10 AND sd > 0 THEN (vwap - mu) / sd END', 'x')} FROM a""")
def rolling_zscore(spark, d):
    p = weekly_panel(spark, d).select("ts", "symbol", F.col("vwap").alias("x"))
    return rounded(T.rolling_zscore(p, "x", window=20, min_periods=10))


@add("transform_rolling_quantile", f"""WITH {panel_sql()},
a AS (SELECT ts, symbol, quantile_cont(ln(vwap), 0.25) OVER w AS q, count(vwap) OVER w AS n,
  list_sort(list(ln(vwap)) OVER w) AS v
  FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT ts, symbol, {r('CASE WHEN n >= 12 THEN q END', 'q_linear')},
  {r('CASE WHEN n >= 12 THEN v[CAST(floor(0.25 * (n - 1) + 0.5) AS BIGINT) + 1] END', 'q_nearest')} FROM a""")
def rolling_quantile(spark, d):
    p = weekly_panel(spark, d).select("ts", "symbol", F.log("vwap").alias("vwap"))
    p = T.rolling_quantile(p, "vwap", window=12, quantile=0.25, interpolation="linear",
                           out="q_linear")
    p = T.rolling_quantile(p, "vwap", window=12, quantile=0.25, out="q_nearest")
    return rounded(p.select("ts", "symbol", "q_linear", "q_nearest"))


_LONG = """ROWS BETWEEN 1999 PRECEDING AND CURRENT ROW"""


@add("transform_rolling_quantile_long", f"""WITH {panel_sql('day')},
a AS (SELECT ts, symbol, count(vwap) OVER w AS n, quantile_cont(vwap, 0.9) OVER w AS q, list_sort(list(vwap) OVER w) AS v
  FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY ts {_LONG}))
SELECT ts, symbol, {r('CASE WHEN n >= 60 THEN q END', 'q_linear')}, {r('CASE WHEN n >= 60 THEN v[CAST(floor(0.9 * (n - 1)) AS BIGINT) + 1] END', 'q_lower')} FROM a""")
def rolling_quantile_long(spark, d):
    p = panel(spark, d, "day").select("ts", "symbol", "vwap")
    p = T.rolling_quantile(p, "vwap", window=2000, min_periods=60, quantile=0.9, interpolation="linear", out="q_linear")
    p = T.rolling_quantile(p, "vwap", window=2000, min_periods=60, quantile=0.9, interpolation="lower", out="q_lower")
    return rounded(p.select("ts", "symbol", "q_linear", "q_lower"))


@add("transform_rolling_rank_long", f"""WITH {panel_sql('day')},
a AS (SELECT ts, symbol, vwap, list(vwap) OVER (PARTITION BY symbol ORDER BY ts {_LONG}) AS v FROM panel)
SELECT ts, symbol, {r('CASE WHEN len(v) >= 60 THEN len(list_filter(v, lambda x: x < vwap)) / len(v) END', 'x')} FROM a""")
def rolling_rank_long(spark, d):
    p = panel(spark, d, "day").select("ts", "symbol", F.col("vwap").alias("x"))
    return rounded(T.rolling_rank(p, "x", window=2000, min_periods=60))


def _ewm(span):
    q = 1 - 2 / (span + 1)
    return (f"sum(b.vwap * pow({q!r}, a.rn - b.rn)) / sum(pow({q!r}, a.rn - b.rn))")


@add("transform_ema_ratio", f"""WITH {panel_sql()},
a AS (SELECT ts, symbol, vwap, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM panel)
SELECT a.ts, a.symbol, {r(f'({_ewm(5)}) / ({_ewm(20)}) - 1', 'x')}
FROM a JOIN a b ON b.symbol = a.symbol AND b.rn <= a.rn GROUP BY a.ts, a.symbol""")
def ema_ratio(spark, d):
    p = weekly_panel(spark, d).select("ts", "symbol", F.col("vwap").alias("x"))
    return rounded(T.ema_ratio(p, "x", fast=5, slow=20))


@add("transform_chain", f"""WITH {panel_sql()},
a AS (SELECT *, median(vwap) OVER (PARTITION BY ts) AS med FROM panel),
b AS (SELECT *, median(abs(vwap - med)) OVER (PARTITION BY ts) * 1.4826 AS mad FROM a),
c AS (SELECT ts, symbol, CASE WHEN mad > 0 THEN least(greatest(vwap, med - 3.0 * mad), med + 3.0 * mad)
  ELSE vwap END AS x FROM b),
d AS (SELECT *, avg(x) OVER (PARTITION BY ts) AS mu, stddev_samp(x) OVER (PARTITION BY ts) AS sd FROM c),
e AS (SELECT ts, symbol, CASE WHEN sd > 0 THEN (x - mu) / sd END AS x FROM d),
f AS (SELECT *, avg(x) OVER w AS mu, stddev_samp(x) OVER w AS sd, count(x) OVER w AS n FROM e
  WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT ts, symbol, {r('CASE WHEN n >= 10 AND sd > 0 THEN (x - mu) / sd END', 'x', 6)} FROM f""")
def chain(spark, d):
    p = weekly_panel(spark, d).select("ts", "symbol", F.col("vwap").alias("x"))
    return rounded(T.apply_steps(p, [
        {"op": "winsorize", "column": "x", "method": "mad", "k": 3.0},
        {"op": "zscore", "column": "x"},
        {"op": "rolling_zscore", "column": "x", "window": 10},
    ]), 6)


@add("transform_clean_non_finite", f"""WITH {panel_sql()}
SELECT ts, symbol, {r('CASE WHEN volume <> 30 THEN ln(amount) / (volume - 30) END', 'x', 6)} FROM panel""")
def clean(spark, d):
    p = weekly_panel(spark, d).select(
        "ts", "symbol",
        F.when(F.col("volume") == 30, F.lit(float("inf")))
        .otherwise(ratio(F.log("amount"), F.col("volume") - 30)).alias("x"))
    return rounded(clean_non_finite(p, ["x"]), 6)


@add("transform_forward_fill", f"""WITH {panel_sql()}
SELECT ts, symbol, {r('''last_value(CASE WHEN volume > 150 THEN vwap END IGNORE NULLS) OVER (
  PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)''', 'x')} FROM panel""")
def ffill(spark, d):
    p = weekly_panel(spark, d).select(
        "ts", "symbol", F.when(F.col("volume") > 150, F.col("vwap")).alias("x"))
    return rounded(T.forward_fill(p, "x"))


_Z = """z AS (SELECT ts, symbol,
  (vwap - avg(vwap) OVER t) / nullif(stddev_samp(vwap) OVER t, 0) AS z1,
  (volume - avg(volume) OVER t) / nullif(stddev_samp(volume) OVER t, 0) AS z2,
  (prev_close - avg(prev_close) OVER t) / nullif(stddev_samp(prev_close) OVER t, 0) AS z3
  FROM panel WINDOW t AS (PARTITION BY ts))"""


@add("transform_combine_scores", f"""WITH {panel_sql()}, {_Z}
SELECT ts, symbol, {r('(coalesce(z1, 0) + coalesce(z2, 0) + coalesce(z3, 0)) / 3', 'equal')},
  {r('(0.03 * coalesce(z1, 0) - 0.01 * coalesce(z2, 0) + 0.02 * coalesce(z3, 0)) / 0.06', 'weighted')} FROM z""")
def combine(spark, d):
    p = weekly_panel(spark, d).select("ts", "symbol", "vwap", "volume", "prev_close")
    f = ["vwap", "volume", "prev_close"]
    p = combine_scores(p, f, out="equal")
    p = combine_scores(p, f, method="ic_weighted", out="weighted",
                       weights={"vwap": 0.03, "volume": -0.01, "prev_close": 0.02})
    return rounded(p.select("ts", "symbol", "equal", "weighted"))


@add("transform_equal_weight_composite", f"""WITH {panel_sql()}, {_Z}
SELECT ts, symbol, {r('(coalesce(z1, 0) + coalesce(z2, 0)) / 2', 'pred')} FROM z""")
def composite(spark, d):
    p = weekly_panel(spark, d)
    return rounded(equal_weight_composite(p, ["vwap", "volume"]).select("ts", "symbol", "pred"))
