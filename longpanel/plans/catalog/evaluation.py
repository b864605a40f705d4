"""Queries for factor evaluation."""

from pyspark.sql import functions as F

from ...functions.columns import ratio
from ...functions.ordered import with_trailing
from ...operators import evaluate as E
from ...operators.validate import feature_leakage
from ...sources.panels import return_series, weekly_panel
from .base import (FACTORS, SERIES, Catalog, corr_sql, ic_sql, ics_summary_sql, long_sql,
                   panel_sql, r, rounded, study, study_sql)

CATALOG = Catalog()
add = CATALOG.add


def _n_ts(df):
    from ...functions.ordered import value_bound
    return value_bound(df, "ts")


@add("eval_ic_series", f"""WITH {study_sql()} {long_sql()} {ic_sql()}
SELECT factor, ts, {r('ic', 'ic')}, n FROM ics""")
def ic_series(spark, d):
    return rounded(E.ic(study(spark, d), FACTORS, "y1"))


@add("eval_ic_pearson", f"""WITH {study_sql()} {long_sql()}
SELECT factor, ts, {r(f"CASE WHEN count(*) >= 20 THEN {corr_sql('value', 'y')} END", 'ic')},
  count(*) AS n FROM lg GROUP BY factor, ts""")
def ic_pearson(spark, d):
    return rounded(E.ic(study(spark, d), FACTORS, "y1", method="pearson"))


_SUM = ", ".join(r(c, c) for c in ("mean", "std", "icir", "t_stat", "positive_rate", "mean_breadth"))


@add("eval_ic_summary", f"""WITH {study_sql()} {long_sql()} {ic_sql()} {ics_summary_sql()}
SELECT factor, {_SUM}, n_periods, n_periods < 30 AS is_thin FROM ics_sum""")
def ic_summary(spark, d):
    return rounded(E.ic_summary(E.ic(study(spark, d), FACTORS, "y1")))


def _nw(lags, by="factor", src="ics"):
    gam = "".join(
        f" + 2 * (1 - {k} / {lags + 1}.0) * coalesce(sum(dv * lag{k}), 0) / count(*)"
        for k in range(1, lags + 1))
    lag = ", ".join(f"lag(dv, {k}) OVER (PARTITION BY {by} ORDER BY ts) AS lag{k}"
                    for k in range(1, lags + 1))
    return f""",
dv AS (SELECT {by}, ts, ic - avg(ic) OVER (PARTITION BY {by}) AS dv FROM {src} WHERE ic IS NOT NULL),
dl AS (SELECT *, {lag} FROM dv),
lr AS (SELECT {by}, greatest(sum(dv * dv) / count(*){gam}, 1e-24) AS lrv, count(*) AS m FROM dl GROUP BY {by})"""


@add("eval_ic_summary_newey_west", f"""WITH {study_sql((5,))} {long_sql(label='y5')} {ic_sql()}
{ics_summary_sql()} {_nw(4)}
SELECT factor, {r('mean', 'mean')}, {r('mean / sqrt(lrv / m)', 't_stat')}, n_periods
FROM ics_sum JOIN lr USING (factor)""")
def ic_newey_west(spark, d):
    s = E.ic_summary(E.ic(study(spark, d, (5,)), FACTORS, "y5"), newey_west_lags=4)
    return rounded(s.select("factor", "mean", "t_stat", "n_periods"))


_BUCKETS = """,
bk AS (SELECT *, row_number() OVER (PARTITION BY factor, ts ORDER BY value, symbol) AS rn,
  count(*) OVER (PARTITION BY factor, ts) AS cnt FROM lg),
pp AS (SELECT factor, ts, CAST(least(((rn - 1) * 5) // cnt, 4) AS INT) AS bucket, avg(y) AS ret, count(*) AS n
  FROM bk WHERE cnt >= 10 GROUP BY ALL),
sp AS (SELECT factor, ts, max(ret) FILTER (WHERE bucket = 4) - max(ret) FILTER (WHERE bucket = 0) AS spread
  FROM pp GROUP BY factor, ts)"""


@add("eval_quantile_returns", f"""WITH {study_sql()} {long_sql(label='y1 * 0.01')} {_BUCKETS}
SELECT factor, ts, bucket, {r('ret', 'ret')}, n, {r('''product(1 + ret) OVER (
  PARTITION BY factor, bucket ORDER BY ts) - 1''', 'cum_ret', 6)} FROM pp""")
def quantile_returns(spark, d):
    s = study(spark, d).withColumn("y1", F.col("y1") * 0.01)
    return rounded(E.quantile_curves(E.bucketed(s, FACTORS, "y1", 5), _n_ts(s)), cum_ret=6)


@add("eval_quantile_weighted", f"""WITH {study_sql()}
{long_sql(keep='ts, symbol, volume')},
bk AS (SELECT *, row_number() OVER (PARTITION BY factor, ts ORDER BY value, symbol) AS rn,
  count(*) OVER (PARTITION BY factor, ts) AS cnt FROM lg)
SELECT factor, ts, CAST(least(((rn - 1) * 10) // cnt, 9) AS INT) AS bucket,
  {r('sum(y * volume) / sum(volume)', 'ret')}, count(*) AS n FROM bk WHERE cnt >= 20 GROUP BY ALL""")
def quantile_weighted(spark, d):
    return rounded(E.bucketed(study(spark, d), FACTORS, "y1", 10, weight="volume"))


@add("eval_quantile_spread", f"""WITH {study_sql()} {long_sql(label='y1 * 0.01')} {_BUCKETS}
SELECT factor, ts, {r('spread', 'spread')}, {r('''product(1 + spread) OVER (
  PARTITION BY factor ORDER BY ts) - 1''', 'cum_spread', 6)} FROM sp WHERE spread IS NOT NULL""")
def quantile_spread(spark, d):
    s = study(spark, d).withColumn("y1", F.col("y1") * 0.01)
    return rounded(E.quantile_spread(E.bucketed(s, FACTORS, "y1", 5), 5, _n_ts(s)), cum_spread=6)


_QSUM = """,
bm AS (SELECT factor, bucket, avg(ret) AS mr FROM pp GROUP BY factor, bucket),
br AS (SELECT factor, bucket, rank() OVER (PARTITION BY factor ORDER BY mr) AS rk FROM bm),
mo AS (SELECT factor, corr(bucket, rk) AS monotonicity FROM br GROUP BY factor),
qs AS (SELECT factor, avg(spread) AS sm, stddev_samp(spread) AS sd, count(spread) AS np FROM sp
  WHERE spread IS NOT NULL GROUP BY factor)"""


@add("eval_quantile_summary", f"""WITH {study_sql()} {long_sql()} {_BUCKETS} {_QSUM}
SELECT factor, {r('monotonicity', 'monotonicity')}, {r('sm', 'spread_mean')}, {r('sm / sd', 'spread_sharpe')},
  np AS n_periods, np < 30 AS is_thin FROM mo JOIN qs USING (factor)""")
def quantile_summary(spark, d):
    s = study(spark, d)
    return rounded(E.quantile_summary(E.bucketed(s, FACTORS, "y1", 5), 5, _n_ts(s)))


_HORIZONS = (1, 2, 5, 10)
_DECAY_LONG = ",\nlg AS (" + " UNION ALL ".join(
    f"SELECT ts, symbol, {h} AS horizon, rev_5 AS value, y{h} AS y FROM st WHERE rev_5 IS NOT NULL AND y{h} IS NOT NULL"
    for h in _HORIZONS) + ")"
_GAMMA = "".join(
    f" + CASE WHEN horizon > {k} THEN 2 * (1 - {k} / CAST(horizon AS DOUBLE)) * coalesce(sum(dv * lag{k}), 0) / count(*) ELSE 0 END"
    for k in range(1, max(_HORIZONS)))
_LAGS = ", ".join(f"lag(dv, {k}) OVER (PARTITION BY horizon ORDER BY ts) AS lag{k}"
                  for k in range(1, max(_HORIZONS)))
_DECAY = f"""WITH {study_sql(_HORIZONS)} {_DECAY_LONG} {ic_sql(by='horizon, ts')}
{ics_summary_sql(by='horizon')},
dv AS (SELECT horizon, ts, ic - avg(ic) OVER (PARTITION BY horizon) AS dv FROM ics WHERE ic IS NOT NULL),
dl AS (SELECT *, {_LAGS} FROM dv),
lr AS (SELECT horizon, greatest(sum(dv * dv) / count(*){_GAMMA}, 1e-24) AS lrv FROM dl GROUP BY horizon),
cv AS (SELECT horizon, mean AS ic, CASE WHEN horizon > 1 THEN mean / sqrt(lrv / n_periods) ELSE t_stat END AS t_stat,
  n_periods FROM ics_sum JOIN lr USING (horizon))"""


@add("eval_decay", f"""{_DECAY}
SELECT CAST(horizon AS INT) AS horizon, {r('ic', 'ic')}, {r('t_stat', 't_stat')}, n_periods FROM cv""")
def decay(spark, d):
    s = study(spark, d, _HORIZONS)
    return rounded(E.decay(s, "rev_5", {h: f"y{h}" for h in _HORIZONS}))


@add("eval_half_life", f"""{_DECAY},
pk AS (SELECT arg_max(horizon, abs(ic)) AS ph, arg_max(ic, abs(ic)) AS pi, max(abs(ic)) AS top FROM cv),
sq AS (SELECT horizon, abs(ic) AS a, lag(horizon) OVER (ORDER BY horizon) AS x0, lag(abs(ic)) OVER (ORDER BY horizon) AS y0 FROM cv),
ht AS (SELECT arg_min(CASE WHEN y0 = a THEN horizon ELSE x0 + (y0 - top / 2) * (horizon - x0) / (y0 - a) END, horizon) AS hl
  FROM sq, pk WHERE horizon > ph AND a <= top / 2)
SELECT CAST(ph AS INT) AS peak_horizon, {r('pi', 'peak_ic')}, {r("coalesce(hl, CAST('inf' AS DOUBLE))", 'half_life')} FROM pk, ht""")
def half_life(spark, d):
    s = study(spark, d, _HORIZONS)
    return rounded(E.half_life(E.decay(s, "rev_5", {h: f"y{h}" for h in _HORIZONS})))


_TURN_LONG = ",\nvl AS (" + " UNION ALL ".join(
    f"SELECT ts, symbol, '{f}' AS factor, CAST({f} AS DOUBLE) AS value FROM st WHERE {f} IS NOT NULL"
    for f in FACTORS) + ")"
_TURN = f"""{_TURN_LONG},
kp AS (SELECT factor, ts, row_number() OVER (PARTITION BY factor ORDER BY ts) AS k
  FROM (SELECT factor, ts FROM vl GROUP BY factor, ts HAVING count(*) >= 20)),
vr AS (SELECT vl.*, k, rank() OVER (PARTITION BY factor, ts ORDER BY value) + (count(*) OVER (PARTITION BY factor, ts, value) - 1) / 2.0 AS rk
  FROM vl JOIN kp USING (factor, ts)),
tp AS (SELECT c.factor, c.ts, p.rk AS value, c.rk AS y FROM vr c JOIN vr p ON p.factor = c.factor AND p.symbol = c.symbol AND p.k = c.k - 1)
{ic_sql(src='tp', out='tc')},
tn AS (SELECT factor, ts, 1 - ic AS turnover, n FROM tc WHERE ic IS NOT NULL)"""


@add("eval_turnover", f"""WITH {study_sql()} {_TURN}
SELECT factor, ts, {r('turnover', 'turnover')}, n FROM tn""")
def turnover(spark, d):
    return rounded(E.turnover(study(spark, d), FACTORS))


@add("eval_turnover_summary", f"""WITH {study_sql()} {_TURN}
SELECT factor, {r('avg(turnover)', 'mean')}, {r('stddev_samp(turnover)', 'std')}, count(*) AS n_periods,
  {r('1 / avg(turnover)', 'implied_holding')}, count(*) < 30 AS is_thin FROM tn GROUP BY factor""")
def turnover_summary(spark, d):
    return rounded(E.turnover_summary(E.turnover(study(spark, d), FACTORS)))


@add("eval_factor_ranking", f"""WITH {study_sql()} {long_sql()} {ic_sql()} {ics_summary_sql()} {_BUCKETS} {_QSUM} {_TURN}
SELECT factor, {r('mean', 'ic')}, {r('icir', 'icir')}, {r('t_stat', 't_stat')}, {r('positive_rate', 'pos_rate')},
  n_periods AS periods, {r('mean_breadth', 'breadth')}, {r('tv', 'turnover')}, {r('sm', 'q_spread')},
  {r('monotonicity', 'monotonic')}, {r('abs(icir)', 'abs_icir')}
FROM ics_sum JOIN (SELECT factor, avg(turnover) AS tv FROM tn GROUP BY factor) USING (factor)
JOIN mo USING (factor) JOIN qs USING (factor)""")
def ranking(spark, d):
    return rounded(E.factor_ranking(study(spark, d), FACTORS, "y1"))


@add("eval_coverage", f"""WITH {study_sql()}
SELECT factor, {r('cov', 'coverage')}, cov < 0.5 AS is_low FROM (
  SELECT 'rev_5' AS factor, count(rev_5) / count(*) AS cov FROM st UNION ALL
  SELECT 'drive', count(drive) / count(*) FROM st UNION ALL
  SELECT 'log_volume', count(log_volume) / count(*) FROM st)""")
def coverage(spark, d):
    return rounded(E.coverage(study(spark, d), FACTORS))


_SIG = f"""WITH {panel_sql()} {SERIES},
sg AS (SELECT series, ts, ret AS sig, lead(ret) OVER (PARTITION BY series ORDER BY ts) AS nxt FROM series)"""


def _signal(spark, d):
    s = return_series(spark, d)
    s = s.withColumn("neg", -F.unix_micros(F.col("ts").cast("timestamp")))
    return with_trailing(s, ["series"], ["neg"], 1, lambda x, t: x.withColumn(
        "nxt", t.lag(F.col("ret")))).withColumnRenamed("ret", "sig")


@add("eval_conditional_by_quantile", f"""{_SIG},
v AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY sig, ts) AS rn, count(*) OVER (PARTITION BY series) AS cnt
  FROM sg WHERE sig IS NOT NULL AND nxt IS NOT NULL)
SELECT series, CAST(least(((rn - 1) * 5) // cnt, 4) AS INT) AS bucket, {r('min(sig)', 'lo')}, {r('max(sig)', 'hi')},
  {r('avg(nxt)', 'mean_ret')}, count(*) AS n FROM v WHERE cnt >= 30 GROUP BY series, bucket""")
def conditional(spark, d):
    return rounded(E.conditional_return_by_quantile(_signal(spark, d), "sig", "nxt"))


@add("eval_rolling_corr", f"""{_SIG},
w AS (SELECT series, ts, count(CASE WHEN nxt IS NOT NULL THEN sig END) OVER q AS n,
  covar_samp(CASE WHEN nxt IS NOT NULL THEN sig END, nxt) OVER q AS cv,
  stddev_samp(CASE WHEN nxt IS NOT NULL THEN sig END) OVER q AS sa, stddev_samp(nxt) OVER q AS sb FROM sg
  WINDOW q AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))
SELECT series, ts, {r('CASE WHEN n >= 13 AND sa > 0 AND sb > 0 THEN cv / (sa * sb) END', 'corr', 6)} FROM w""")
def rolling_corr(spark, d):
    return rounded(E.rolling_corr(_signal(spark, d), "sig", "nxt", 26, min_periods=13), 6)


_GRID_SQL = " UNION ALL ".join(
    f"SELECT {a} AS lookback, {b} AS skip, avg(v{a}_{b} * y1) / stddev_samp(v{a}_{b} * y1) AS score FROM gr"
    for a in (5, 10, 20) for b in (0, 1, 2))
_GRID_COLS = ", ".join(
    f"lag(close, {b}) OVER s / lag(close, {a + b}) OVER s - 1 AS v{a}_{b}"
    for a in (5, 10, 20) for b in (0, 1, 2))
_GRID = f"""WITH {study_sql()},
gr AS (SELECT *, {_GRID_COLS} FROM st WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
sc AS ({_GRID_SQL})"""


def grid_scores(spark, d):
    """Momentum over a (lookback, skip) grid, scored in one aggregate."""
    combos = [(a, b) for a in (5, 10, 20) for b in (0, 1, 2)]

    def build(df, t):
        px = F.col("close")
        return df.withColumns({
            f"v{a}_{b}": ratio(t.lag(px, b) if b else px, t.lag(px, a + b)) - 1 for a, b in combos})

    g = with_trailing(study(spark, d), ["symbol"], ["ts"], 22, build)
    one = g.agg(*[ratio(F.avg(F.col(f"v{a}_{b}") * F.col("y1")),
                        F.stddev_samp(F.col(f"v{a}_{b}") * F.col("y1"))).alias(f"v{a}_{b}")
                  for a, b in combos])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("lookback"), F.lit(b).alias("skip"), F.col(f"v{a}_{b}").alias("score"))
        for a, b in combos])).alias("x")).select("x.*")


@add("eval_parameter_surface", f"""{_GRID},
bs AS (SELECT arg_max(lookback, score) AS bl, arg_max(skip, score) AS bk, max(score) AS top FROM sc),
ax AS (SELECT sc.*, CASE lookback WHEN 5 THEN 0 WHEN 10 THEN 1 ELSE 2 END AS ol,
  CASE bl WHEN 5 THEN 0 WHEN 10 THEN 1 ELSE 2 END AS obl, bl, bk, top FROM sc, bs),
nb AS (SELECT avg(score) FILTER (WHERE abs(ol - obl) + abs(skip - bk) = 1) AS near, count(*) AS n_points FROM ax)
SELECT bl AS best_lookback, bk AS best_skip, {r('top', 'best_score')},
  {r('CASE WHEN top > 0 THEN near / top ELSE 0 END', 'plateau_score')},
  CASE WHEN top > 0 THEN near / top ELSE 0 END < 0.6 AS is_isolated_peak, n_points FROM bs, nb""")
def surface(spark, d):
    return rounded(E.parameter_surface(grid_scores(spark, d), ["lookback", "skip"]))


@add("eval_feature_leakage", f"""WITH {study_sql()}, ad AS (SELECT *, y1 * 2 AS planted FROM st)
{long_sql('ad', (*FACTORS, 'planted'))} {ic_sql()} {ics_summary_sql()}
SELECT factor, {r('mean', 'mean_ic')}, n_periods, n_periods > 0 AND abs(mean) >= 0.95 AS leaks FROM ics_sum""")
def leak_canary(spark, d):
    s = study(spark, d).withColumn("planted", F.col("y1") * 2)
    return rounded(feature_leakage(s, (*FACTORS, "planted"), "y1"))


@add("eval_flagship_reversal_ic", f"""WITH {study_sql()},
m1 AS (SELECT *, median(rev_5) OVER (PARTITION BY ts) AS med FROM st),
m2 AS (SELECT *, median(abs(rev_5 - med)) OVER (PARTITION BY ts) * 1.4826 AS mad FROM m1),
m3 AS (SELECT *, CASE WHEN mad > 0 AND rev_5 IS NOT NULL THEN least(greatest(rev_5, med - 3 * mad), med + 3 * mad) ELSE rev_5 END AS wx FROM m2),
m4 AS (SELECT *, (wx - avg(wx) OVER (PARTITION BY ts)) / nullif(stddev_samp(wx) OVER (PARTITION BY ts), 0) AS zx FROM m3)
{long_sql('m4', ('zx',))} {ic_sql()}
SELECT 'rev_5' AS factor, ts, {r('ic', 'ic')}, n FROM ics""")
def flagship(spark, d):
    from ..studies import reversal_ic
    return reversal_ic(spark, d)
