"""Shared parts of the query catalogue.

Every entry pairs a Spark query with the SQL that states the same result over the same tables.
The SQL is written from the definition of the operator, not from its Spark plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Named queries with the SQL they are checked against."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def deco(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name!r} is already registered")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return deco


def rounded(df: DataFrame, digits: int = 8, **special: int) -> DataFrame:
    """Round every double column so that summation order cannot show; -0.0 becomes 0.0."""
    cols = []
    for f in df.schema:
        if f.dataType.simpleString() == "double":
            cols.append((F.round(F.col(f.name), special.get(f.name, digits)) + 0.0).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def r(expr: str, name: str, digits: int = 8) -> str:
    """SQL counterpart of :func:`rounded` for one column."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def _bars(unit: str) -> str:
    return f"""
li AS (
  SELECT CAST(date_trunc('{unit}', l_shipdate) AS TIMESTAMP) AS ts,
         lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, l_suppkey,
         l_extendedprice / l_quantity AS p, l_quantity AS q, l_extendedprice AS a,
         l_shipdate, l_orderkey, l_linenumber
  FROM lineitem),
bars AS (
  SELECT ts, symbol, l_suppkey,
         first(p ORDER BY l_shipdate, l_orderkey, l_linenumber, a) AS open,
         max(p) AS high, min(p) AS low,
         last(p ORDER BY l_shipdate, l_orderkey, l_linenumber, a) AS close,
         CAST(sum(CAST(q AS DECIMAL(18,2))) AS DOUBLE) AS volume,
         CAST(sum(CAST(a AS DECIMAL(18,2))) AS DOUBLE) AS amount
  FROM li GROUP BY ts, symbol, l_suppkey)"""


def panel_sql(unit: str = "week") -> str:
    """CTEs ``li``, ``bars`` and ``panel``."""
    return _bars(unit) + """,
panel AS (
  SELECT b.ts, b.symbol, b.l_suppkey, open, high, low, close,
         lag(close) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS prev_close,
         amount / volume AS vwap, volume, amount, volume / 1000 AS turnover,
         close AS adj_close, round(ln(volume + 1), 9) AS log_volume,
         s_acctbal AS market_cap, n_name AS industry
  FROM bars b JOIN supplier ON s_suppkey = b.l_suppkey
              JOIN nation ON n_nationkey = s_nationkey)"""


def bars_sql(unit: str = "week") -> str:
    return _bars(unit)


MARKET = """,
mkt AS (
  SELECT *, avg(_r1) OVER (PARTITION BY ts) AS mkt_ret
  FROM (SELECT *, close / prev_close - 1 AS _r1 FROM panel))"""

SERIES = """,
series AS (
  SELECT industry AS series, ts, avg(close / prev_close - 1) AS ret
  FROM panel WHERE prev_close IS NOT NULL GROUP BY industry, ts)"""


def slots_sql(source: str = "panel", name: str = "slotted") -> str:
    """``source`` with its dense slot number."""
    return f""",
{name} AS (SELECT p.*, o.slot FROM {source} p JOIN (
  SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS slot FROM (SELECT DISTINCT ts FROM {source})) o
  USING (ts))"""


def forward_sql(n: int, price: str = "vwap", lag: int = 1, label: str = "fwd_ret",
                source: str = "slotted", name: str = "labelled", keep: str = "a.*") -> str:
    """``source`` with a forward return addressed by slot number."""
    return f""",
{name} AS (SELECT {keep}, CASE WHEN e.{price} > 0 THEN x.{price} / e.{price} - 1 END AS {label}
  FROM {source} a
  LEFT JOIN {source} e ON e.symbol = a.symbol AND e.slot = a.slot + {lag}
  LEFT JOIN {source} x ON x.symbol = a.symbol AND x.slot = a.slot + {lag + n})"""


def avg_rank(value: str, by: str) -> str:
    """SQL average rank of the non-null values of a group."""
    return (f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) + "
            f"(count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0)")


def corr_sql(x: str, y: str) -> str:
    """Correlation that is NULL when a side has no dispersion."""
    return (f"CASE WHEN stddev_pop({x}) > 1e-12 AND stddev_pop({y}) > 1e-12 "
            f"THEN corr({x}, {y}) END")


def union_columns(cols: Sequence[str], source: str, keep: str) -> str:
    """Wide to long in SQL."""
    return " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS factor, {c} AS value FROM {source}" for c in cols)


FACTORS = ("rev_5", "drive", "log_volume")


def study_sql(horizons: Sequence[int] = (1,)) -> str:
    """CTEs up to ``st``: panel rows with three factors and one label per horizon."""
    joins, cols = [], []
    for k in sorted({1, *[1 + h for h in horizons]}):
        joins.append(f"LEFT JOIN sl p{k} ON p{k}.symbol = a.symbol AND p{k}.slot = a.slot + {k}")
    for h in horizons:
        cols.append(f"CASE WHEN p1.vwap > 0 THEN p{1 + h}.vwap / p1.vwap - 1 END AS y{h}")
    return panel_sql() + """,
ft AS (SELECT *, -(close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts) - 1) AS rev_5,
  (close - open) / (high - low + 0.001) AS drive FROM panel)""" + slots_sql("ft", "sl") + f""",
st AS (SELECT a.*, {', '.join(cols)} FROM sl a {' '.join(joins)})"""


def study(spark: SparkSession, sf_dir: str, horizons: Sequence[int] = (1,)) -> DataFrame:
    """Spark counterpart of :func:`study_sql`."""
    from ...functions.columns import ratio
    from ...functions.ordered import with_trailing
    from ...operators.labels import forward_returns
    from ...sources.panels import weekly_panel

    p = weekly_panel(spark, sf_dir)
    p = with_trailing(p, ["symbol"], ["ts"], 5, lambda d, t: d.withColumn(
        "rev_5", -(ratio(F.col("close"), t.lag(F.col("close"), 5)) - 1)))
    p = p.withColumn("drive", ratio(F.col("close") - F.col("open"),
                                    F.col("high") - F.col("low") + 0.001))
    return forward_returns(p, {f"y{h}": h for h in horizons})


def long_sql(source: str = "st", factors: Sequence[str] = FACTORS, label: str = "y1",
             keep: str = "ts, symbol, industry") -> str:
    """CTE ``lg``: one row per (factor, ts, symbol) with both sides present."""
    parts = " UNION ALL ".join(
        f"SELECT {keep}, '{f}' AS factor, CAST({f} AS DOUBLE) AS value, {label} AS y FROM {source}"
        for f in factors)
    return f""",
lg AS (SELECT * FROM ({parts}) WHERE value IS NOT NULL AND y IS NOT NULL)"""


def ic_sql(min_names: int = 20, by: str = "factor, ts", src: str = "lg", out: str = "ics") -> str:
    """CTE ``ics``: Spearman correlation per group from ``value`` and ``y``."""
    return f""",
{out}_rk AS (SELECT {by}, {avg_rank('value', by)} AS rx, {avg_rank('y', by)} AS ry FROM {src}),
{out} AS (SELECT {by}, CASE WHEN count(*) >= {min_names} THEN {corr_sql('rx', 'ry')} END AS ic,
  count(*) AS n FROM {out}_rk GROUP BY {by})"""


def ics_summary_sql(by: str = "factor", src: str = "ics", out: str = "ics_sum") -> str:
    return f""",
{out} AS (SELECT {by}, coalesce(avg(ic), 0) AS mean, coalesce(stddev_samp(ic), 0) AS std,
  CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) ELSE 0 END AS icir,
  CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) * sqrt(count(ic)) ELSE 0 END AS t_stat,
  coalesce(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END), 0) AS positive_rate,
  count(ic) AS n_periods, avg(n) AS mean_breadth FROM {src} GROUP BY {by})"""
