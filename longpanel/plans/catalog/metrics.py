"""Queries for return-series metrics."""

from pyspark.sql import functions as F

from ...operators import metrics as M
from ...operators.evaluate import ic
from ...sources.panels import return_series, weekly_panel
from .base import SERIES, Catalog, ic_sql, long_sql, panel_sql, r, rounded, study, study_sql, FACTORS

CATALOG = Catalog()
add = CATALOG.add

# weekly returns of single order lines are wild; a shifted share of them makes a tame series
_S = f"""WITH {panel_sql()} {SERIES},
s AS (SELECT series, ts, (ret - 3) * 0.01 AS ret FROM series),
eq AS (SELECT series, ts, ret, product(1 + ret) OVER (PARTITION BY series ORDER BY ts) AS equity FROM s),
cv AS (SELECT *, max(equity) OVER (PARTITION BY series ORDER BY ts) AS peak FROM eq),
un AS (SELECT *, sum(CASE WHEN equity < peak THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY ts) AS run FROM cv),
dd AS (SELECT series, max(len) AS dur FROM (SELECT series, run, sum(CASE WHEN equity < peak THEN 1 ELSE 0 END) AS len
  FROM un GROUP BY series, run) GROUP BY series),
mo AS (SELECT series, avg(CASE WHEN mr > 0 THEN 1.0 ELSE 0.0 END) AS wr FROM (
  SELECT series, date_trunc('month', ts) AS m, product(1 + ret) - 1 AS mr FROM s GROUP BY ALL) GROUP BY series),
st AS (SELECT series, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS sd FROM s GROUP BY series),
mx AS (SELECT series, arg_max(equity, ts) AS eend, min(equity / peak - 1) AS mdd FROM cv GROUP BY series),
pf AS (SELECT *, power(eend, 1 / (n / 52.0)) - 1 AS ann FROM st JOIN mx USING (series) JOIN dd USING (series) JOIN mo USING (series))"""


def _series(spark, d):
    return return_series(spark, d).withColumn("ret", (F.col("ret") - 3) * 0.01)


@add("metric_sharpe", f"""{_S} SELECT series, {r('CASE WHEN n >= 2 AND sd > 1e-9 * abs(m) THEN m / sd * sqrt(52.0) ELSE 0 END', 'sharpe')} FROM st""")
def sharpe(spark, d):
    return rounded(M.sharpe(_series(spark, d), ppy=52.0))


@add("metric_max_drawdown", f"{_S} SELECT series, {r('mdd', 'max_drawdown')} FROM mx")
def max_drawdown(spark, d):
    return rounded(M.max_drawdown(_series(spark, d)))


@add("metric_drawdown_duration", f"{_S} SELECT series, CAST(dur AS BIGINT) AS drawdown_duration FROM dd")
def drawdown_duration(spark, d):
    return M.drawdown_duration(_series(spark, d))


@add("metric_calmar", f"{_S} SELECT series, {r('CASE WHEN mdd < 0 THEN ann / abs(mdd) ELSE 0 END', 'calmar')} FROM pf")
def calmar(spark, d):
    return rounded(M.calmar(_series(spark, d), ppy=52.0))


@add("metric_monthly_winrate", f"{_S} SELECT series, {r('wr', 'monthly_winrate')} FROM mo")
def winrate(spark, d):
    return rounded(M.monthly_winrate(_series(spark, d)))


@add("metric_performance", f"""{_S} SELECT series, n, CAST(52 AS DOUBLE) AS periods_per_year,
  {r('eend - 1', 'total_return')}, {r('ann', 'ann_return')}, {r('sd * sqrt(52.0)', 'ann_vol')},
  {r('m / sd * sqrt(52.0)', 'sharpe')}, {r('mdd', 'max_drawdown')}, CAST(dur AS BIGINT) AS drawdown_duration,
  {r('CASE WHEN mdd < 0 THEN ann / abs(mdd) ELSE 0 END', 'calmar')}, {r('wr', 'monthly_winrate')}, n < 52 AS is_thin FROM pf""")
def performance(spark, d):
    return rounded(M.performance(_series(spark, d), ppy=52.0))


@add("metric_equity_curve", f"{_S} SELECT series, ts, {r('equity', 'equity')}, {r('peak', 'peak')}, {r('equity / peak - 1', 'drawdown')} FROM cv")
def equity(spark, d):
    return rounded(M.equity_curve(_series(spark, d)))


@add("metric_rolling_sharpe", f"""{_S},
w AS (SELECT series, ts, count(*) OVER q AS n, avg(ret) OVER q AS m, stddev_samp(ret) OVER q AS sd FROM s
  WINDOW q AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT series, ts, {r('CASE WHEN n >= 20 THEN m / sd * sqrt(52.0) END', 'rolling_sharpe', 6)} FROM w""")
def rolling_sharpe(spark, d):
    return rounded(M.rolling_sharpe(_series(spark, d), ppy=52.0), 6)


@add("metric_cumulative_ic", f"""WITH {study_sql()} {long_sql()} {ic_sql()}
SELECT factor, ts, {r('sum(coalesce(ic, 0)) OVER (PARTITION BY factor ORDER BY ts)', 'cum_ic')} FROM ics""")
def cumulative_ic(spark, d):
    s = ic(study(spark, d), FACTORS, "y1")
    return rounded(M.cumulative_series(s, "ic", series="factor", out="cum_ic"))


@add("metric_provenance", f"""WITH {panel_sql()}
SELECT min(ts) AS sample_start, max(ts) AS sample_end, count(DISTINCT ts) AS n_periods FROM panel""")
def provenance(spark, d):
    return M.provenance(weekly_panel(spark, d))
