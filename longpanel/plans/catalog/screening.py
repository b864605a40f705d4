"""Queries for redundancy screening."""

from pyspark.sql import functions as F

from ...functions.ordered import durable, shared_dir
from ...operators import ledger as L
from ...operators import screen as S
from .base import Catalog, corr_sql, r, rounded, study, study_sql

CATALOG = Catalog()
add = CATALOG.add

COLS = ("amount", "drive", "log_volume", "rev_5", "turnover", "vwap")
_RANKS = ", ".join(
    f"rank() OVER (PARTITION BY ts ORDER BY {c}) + (count(*) OVER (PARTITION BY ts, {c}) - 1) / 2.0 AS r_{c}"
    for c in COLS)
_PAIRS = " UNION ALL ".join(
    f"SELECT ts, '{a}' AS f1, '{b}' AS f2, CASE WHEN count(*) >= 20 THEN {corr_sql(f'r_{a}', f'r_{b}')} END AS rho FROM rk GROUP BY ts"
    for i, a in enumerate(COLS) for b in COLS[i + 1:])
_Q = f"""WITH {study_sql()},
cp AS (SELECT * FROM st WHERE {' AND '.join(f'{c} IS NOT NULL' for c in COLS)}),
rk AS (SELECT ts, symbol, {_RANKS} FROM cp),
pr AS (SELECT f1, f2, avg(rho) AS rho, count(rho) AS n_ts FROM ({_PAIRS}) GROUP BY f1, f2),
both_ AS (SELECT f1, f2, rho FROM pr UNION ALL SELECT f2, f1, rho FROM pr)"""


@add("screen_correlation_pairs", f"{_Q} SELECT f1, f2, {r('rho', 'rho')}, n_ts FROM pr")
def pairs(spark, d):
    return rounded(S.correlation_pairs(study(spark, d), COLS))


@add("screen_correlation_matrix", f"""{_Q} SELECT f1, f2, {r('rho', 'rho')} FROM both_
UNION ALL SELECT f, f, 1.0 FROM (SELECT f1 AS f FROM both_ GROUP BY f1)""")
def matrix(spark, d):
    return rounded(S.correlation_matrix(S.correlation_pairs(study(spark, d), COLS)))


@add("screen_verdicts", f"""{_Q},
hit AS (SELECT f1 AS candidate, max(abs(rho)) AS m, arg_max(f2, abs(rho)) AS w FROM both_
  WHERE f1 IN ('amount', 'turnover', 'vwap') AND f2 IN ('drive', 'log_volume', 'rev_5') GROUP BY f1)
SELECT candidate, CASE WHEN m >= 0.95 THEN 'reject' WHEN m >= 0.2 THEN 'orthogonalize' ELSE 'admit' END AS verdict,
  {r('m', 'max_abs_corr')}, w AS most_correlated FROM hit""")
def verdicts(spark, d):
    p = S.correlation_pairs(study(spark, d), COLS)
    return rounded(S.screen(p, ["drive", "log_volume", "rev_5"], ["amount", "turnover", "vwap"],
                            threshold=0.2))


@add("screen_orthogonalize_one", f"""WITH {study_sql()},
v AS (SELECT ts, symbol, ln(vwap) AS vwap, log_volume FROM st),
f AS (SELECT ts, regr_slope(vwap, log_volume) AS b, avg(vwap) AS my, avg(log_volume) AS mx, count(*) AS n FROM v GROUP BY ts)
SELECT v.ts, symbol, {r('CASE WHEN n >= 10 THEN vwap - my - b * (log_volume - mx) END', 'x', 6)}
FROM v JOIN f ON f.ts = v.ts""")
def ortho_one(spark, d):
    s = S.orthogonalize(study(spark, d).withColumn("vwap", F.log("vwap")), "vwap", ["log_volume"], out="x")
    return rounded(s.select("ts", "symbol", "x"), 6)


@add("screen_orthogonalize_two", f"""WITH {study_sql()},
v AS (SELECT ts, symbol, ln(vwap) AS y, log_volume AS a, drive AS b FROM st),
c AS (SELECT ts, symbol, y - avg(y) OVER t AS y, a - avg(a) OVER t AS a, b - avg(b) OVER t AS b FROM v WINDOW t AS (PARTITION BY ts)),
g AS (SELECT ts, sum(a*a) AS aa, sum(b*b) AS bb, sum(a*b) AS ab, sum(a*y) AS ay, sum(b*y) AS by_, count(*) AS n FROM c GROUP BY ts),
k AS (SELECT ts, n, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ba, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS bb_ FROM g)
SELECT c.ts, symbol, {r('CASE WHEN n >= 10 THEN y - ba * a - bb_ * b END', 'x', 6)} FROM c JOIN k ON k.ts = c.ts""")
def ortho_two(spark, d):
    s = S.orthogonalize(study(spark, d).withColumn("vwap", F.log("vwap")), "vwap", ["log_volume", "drive"], out="x")
    return rounded(s.select("ts", "symbol", "x"), 6)


@add("screen_orthogonalize_symmetric", f"""WITH {study_sql()},
z AS (SELECT ts, symbol, (vwap - avg(vwap) OVER t) / stddev_samp(vwap) OVER t AS y,
  (log_volume - avg(log_volume) OVER t) / stddev_samp(log_volume) OVER t AS a, count(*) OVER t AS n
  FROM st WINDOW t AS (PARTITION BY ts)),
c AS (SELECT *, corr(y, a) OVER (PARTITION BY ts) AS rho FROM z),
w AS (SELECT *, (1 / sqrt(1 + rho) + 1 / sqrt(1 - rho)) / 2 AS p, (1 / sqrt(1 + rho) - 1 / sqrt(1 - rho)) / 2 AS q FROM c)
SELECT ts, symbol, {r('CASE WHEN n >= 10 THEN p * a + q * y END', 'log_volume', 6)},
  {r('CASE WHEN n >= 10 THEN q * a + p * y END', 'vwap', 6)} FROM w""")
def ortho_symmetric(spark, d):
    s = S.orthogonalize(study(spark, d).select("ts", "symbol", "vwap", "log_volume"), "vwap",
                        ["log_volume"], method="symmetric")
    return rounded(s, 6)


_NAMES = ("drive", "log_volume", "rev_5", "amount", "turnover")
_LEDGER_PAIRS = " UNION ALL ".join(f"SELECT ts, '{a}' AS c, '{b}' AS p, {a} AS x, {b} AS y FROM st WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
                                   for i, a in enumerate(_NAMES) for b in _NAMES[:i])
_LEDGER = f"""WITH RECURSIVE {study_sql()},
pp AS ({_LEDGER_PAIRS}),
pk AS (SELECT ts, c, p, rank() OVER (PARTITION BY c, p, ts ORDER BY x) + (count(*) OVER (PARTITION BY c, p, ts, x) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY c, p, ts ORDER BY y) + (count(*) OVER (PARTITION BY c, p, ts, y) - 1) / 2.0 AS y FROM pp),
pc AS (SELECT c, p, ts, CASE WHEN count(*) >= 20 THEN {corr_sql('x', 'y')} END AS rho FROM pk GROUP BY c, p, ts),
pr AS (SELECT c, p, avg(rho) AS rho, count(rho) AS n_ts FROM pc GROUP BY c, p)"""


# the fold over the candidates, in their order: what is not rejected joins the pool that the next one meets
def _fold(pairs):
    return f"""nm AS (SELECT * FROM (VALUES {', '.join(f"({i + 1}, '{n}')" for i, n in enumerate(_NAMES))}) v(step, factor)),
fd AS (SELECT CAST(0 AS BIGINT) AS step, '' AS factor, '' AS verdict, '' AS tested_against, CAST(0 AS DOUBLE) AS m, CAST(NULL AS VARCHAR) AS w, CAST([] AS VARCHAR[]) AS pool
UNION ALL SELECT step, factor, verdict, array_to_string(pool, ', '), m, w, CASE WHEN verdict = 'reject' THEN pool ELSE list_append(pool, factor) END FROM (
  SELECT CAST(n.step AS BIGINT) AS step, n.factor, f.pool, coalesce(x.m, 0) AS m, x.w, CASE WHEN len(f.pool) = 0 THEN 'admit' WHEN x.m IS NULL THEN 'reject'
    WHEN x.m >= 0.95 THEN 'reject' WHEN x.m >= 0.2 THEN 'orthogonalize' ELSE 'admit' END AS verdict
  FROM fd f JOIN nm n ON n.step = f.step + 1 LEFT JOIN LATERAL (
    SELECT max(abs(rho)) AS m, arg_max(p, abs(rho)) AS w FROM {pairs} WHERE c = n.factor AND list_contains(f.pool, p) AND rho IS NOT NULL) x ON true))"""


def _ledger(spark, d):
    if (key := (spark.sparkContext.applicationId, d)) not in _LEDGERS:
        ledger = L.FactorLedger(spark, shared_dir(spark, "ledger"), threshold=0.2)
        # each on the panel as it is, which is written once and not derived again for every test and digest
        panel = durable(study(spark, d).select("ts", "symbol", *_NAMES))
        for name in _NAMES:
            ledger.propose(panel, name)
        _LEDGERS[key] = ledger
    return _LEDGERS[key]


_LEDGERS: dict[tuple, L.FactorLedger] = {}


@add("screen_ledger_log", f"""{_LEDGER}, {_fold('pr')}
SELECT step, factor, verdict, tested_against, {r('m', 'max_abs_corr', 6)}, w AS most_correlated, verdict = 'orthogonalize' AS orthogonalized FROM fd WHERE step > 0""")
def ledger_log(spark, d):
    log = _ledger(spark, d).log()
    return rounded(log.select("step", "factor", "verdict", "tested_against", "max_abs_corr", "most_correlated", "orthogonalized"), 6)


@add("screen_ledger_pairs", f"""{_LEDGER}, {_fold('pr')} SELECT c AS f1, p AS f2, {r('rho', 'rho')}, n_ts FROM pr
JOIN fd ON fd.factor = pr.c AND list_contains(string_split(fd.tested_against, ', '), pr.p)""")
def ledger_pairs(spark, d):
    return rounded(_ledger(spark, d).correlation())


# all candidates are measured on the names that have all of them
@add("screen_admission_log", f"""{_LEDGER.split('pp AS')[0]}
pp AS ({_LEDGER_PAIRS.replace('FROM st', 'FROM (SELECT * FROM st WHERE ' + ' AND '.join(f'{n} IS NOT NULL' for n in _NAMES) + ')')}),
pk AS{_LEDGER.split('pk AS')[1]}, {_fold('pr')},
sm AS (SELECT min(ts) AS sample_start, max(ts) AS sample_end, count(DISTINCT ts) AS n_periods, count(DISTINCT symbol) AS n_names, count(*) AS n_rows FROM st)
SELECT factor, verdict, tested_against, {r('m', 'max_abs_corr')}, w AS most_correlated, verdict = 'orthogonalize' AS orthogonalized,
  CASE WHEN tested_against = '' THEN 'pool is empty' WHEN verdict = 'admit' THEN 'independent enough' WHEN verdict = 'orthogonalize' THEN 'overlaps ' || w
    WHEN w IS NULL THEN 'no timestamp had enough overlapping names' ELSE 'duplicate of ' || w END AS reason, n_periods, n_names, sample_start, sample_end,
  sha256('sample-v1' || chr(31) || strftime(sample_start, '%Y-%m-%d %H:%M:%S') || chr(31) || strftime(sample_end, '%Y-%m-%d %H:%M:%S') || chr(31) || n_names || chr(31) || n_rows) AS sample_digest
FROM fd, sm WHERE step > 0""")
def admission(spark, d):
    pool = S.FactorPool(threshold=0.2)
    pool.propose_all(study(spark, d), ["drive", "log_volume", "rev_5", "amount", "turnover"])
    return rounded(pool.admission_log(spark))


@add("screen_sample_digest", f"""WITH {study_sql()},
a AS (SELECT min(ts) AS sample_start, max(ts) AS sample_end, count(DISTINCT ts) AS n_periods,
  count(DISTINCT symbol) AS n_names, count(*) AS n_rows FROM st)
SELECT *, sha256('sample-v1' || chr(31) || strftime(sample_start, '%Y-%m-%d %H:%M:%S') || chr(31) ||
  strftime(sample_end, '%Y-%m-%d %H:%M:%S') || chr(31) || n_names || chr(31) || n_rows) AS sample_digest FROM a""")
def digest(spark, d):
    return S.sample_digest(study(spark, d))
