"""Queries for forward labels."""

from pyspark.sql import functions as F

from ...operators import labels as L
from ...sources.panels import weekly_panel
from .base import Catalog, forward_sql, panel_sql, r, rounded, slots_sql

CATALOG = Catalog()
add = CATALOG.add


@add("label_slot_index", f"WITH {panel_sql()} {slots_sql()} SELECT ts, symbol, slot FROM slotted")
def slot_index(spark, d):
    return L.slot_index(weekly_panel(spark, d).select("ts", "symbol"), out="slot")


@add("label_forward_return", f"""WITH {panel_sql()} {slots_sql()}
{forward_sql(1, label='y1', name='l1')}
{forward_sql(2, label='y2', source='slotted', name='l2')}
{forward_sql(5, label='y5', source='slotted', name='l5')}
{forward_sql(10, label='y10', source='slotted', name='l10')}
{forward_sql(20, label='y20', source='slotted', name='l20')}
SELECT l1.ts, l1.symbol, {r('y1', 'y1')}, {r('y2', 'y2')}, {r('y5', 'y5')}, {r('y10', 'y10')},
       {r('y20', 'y20')}
FROM l1 JOIN l2 USING (ts, symbol) JOIN l5 USING (ts, symbol) JOIN l10 USING (ts, symbol)
JOIN l20 USING (ts, symbol)""")
def forward_return(spark, d):
    df = L.forward_returns(weekly_panel(spark, d), {f"y{h}": h for h in (1, 2, 5, 10, 20)})
    return rounded(df.select("ts", "symbol", "y1", "y2", "y5", "y10", "y20"))


@add("label_vol_normalized_return", f"""WITH {panel_sql()} {slots_sql()} {forward_sql(5)},
v AS (SELECT *, vwap / lag(vwap) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rr FROM labelled),
w AS (SELECT *, CASE WHEN count(rr) OVER q >= 20 THEN stddev_samp(rr) OVER q END AS vol FROM v
  WINDOW q AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT ts, symbol, {r('CASE WHEN vol > 0 THEN fwd_ret / (vol * sqrt(5.0)) END', 'fwd_ret_vol')}
FROM w""")
def vol_normalized(spark, d):
    df = L.vol_normalized_return(weekly_panel(spark, d), 5)
    return rounded(df.select("ts", "symbol", "fwd_ret_vol"))


@add("label_ternary", f"""WITH {panel_sql()} {slots_sql()} {forward_sql(2)}
SELECT ts, symbol, CAST(CASE WHEN fwd_ret > 0.05 THEN 1 WHEN fwd_ret < -0.05 THEN -1
  WHEN fwd_ret IS NOT NULL THEN 0 END AS TINYINT) AS y3 FROM labelled""")
def ternary(spark, d):
    return L.ternary_label(weekly_panel(spark, d), 2, threshold=0.05).select("ts", "symbol", "y3")


@add("label_overlap_report", f"""WITH {panel_sql()},
lab AS (SELECT * FROM panel WHERE volume > 100)
SELECT count(*) AS n_keys, count(*) FILTER (WHERE l.ts IS NULL) AS n_orphans
FROM (SELECT DISTINCT ts, symbol FROM panel) f LEFT JOIN (SELECT DISTINCT ts, symbol FROM lab) l
ON l.ts = f.ts AND l.symbol = f.symbol""")
def overlap(spark, d):
    p = weekly_panel(spark, d)
    return L.overlap_report(p, p.where(F.col("volume") > 100))


@add("label_advance_to_executable", f"""WITH {panel_sql()},
nx AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nxt FROM (SELECT DISTINCT ts FROM panel))
SELECT nxt AS ts, symbol, {r('close', 'score')} FROM panel JOIN nx USING (ts) WHERE nxt IS NOT NULL""")
def advance(spark, d):
    p = weekly_panel(spark, d).select("ts", "symbol", F.col("close").alias("score"))
    return rounded(L.advance_to_executable(p))
