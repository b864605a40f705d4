"""Queries for partitioned stores, loaders, the schema contract and file formats."""

from pyspark.sql import functions as F

from ...operators.features_daily import compute_features
from ...operators.prepare import market_return
from ...sources import tables as S
from ...sources.panels import weekly_panel
from ...sources.store import Store
from ...functions.ordered import durable, shared_dir
from ...streaming.jobs import run_available
from .base import Catalog, panel_sql, r, rounded

CATALOG = Catalog()
add = CATALOG.add

_STORES: dict[tuple, str] = {}
_WRITTEN: set[tuple[str, str]] = set()
DATASETS = ("daily", "bars_1w", "factor_frame", "index", "ticks", "actions")


def _write(spark, root, name, p):
    """One dataset of the store from the weekly panel ``p``."""
    path = S.DataRoot(spark, root).path(name)
    # two are partitioned by month start, the others by the stamp's own date
    month = F.date_format(F.trunc(F.to_date("ts"), "month"), "yyyyMMdd")
    if name == "daily":
        daily = p.select("ts", "symbol", "open", "close", "volume", "industry").withColumn(
            "date", F.date_format("ts", "yyyyMMdd"))
        S.write_partitioned(daily.drop("ts"), path)
    elif name == "bars_1w":
        S.write_partitioned(p.select("ts", "symbol", "open", "high", "low", "close", "volume", "amount", "vwap", "turnover"), path)
    elif name == "factor_frame":
        f = compute_features(market_return(p), ["rev_5", "vol_20", "size"])
        S.write_partitioned(f.withColumn("date", month), path)
        S.Fingerprint.of([S.FactorSpec("rev_5", {"n": 5}), S.FactorSpec("vol_20", {"n": 20}), "size"],
                         "weekly").save(spark, path)
    elif name == "index":
        idx = p.groupBy("ts").agg(F.avg("close").alias("close")).select(
            "ts", F.lit("EW.ALL").alias("symbol"), "close")
        S.write_partitioned(idx.withColumn("date", month), path)
    elif name == "ticks":
        S.write_partitioned(p.select("ts", "symbol", F.col("close").alias("last"), "volume"), path, by_symbol=False, files_per_date=2)
    elif name == "actions":
        year = F.date_format(F.trunc(F.to_date("ts"), "year"), "yyyyMMdd")
        S.write_partitioned(p.select("ts", "symbol", "close", year.alias("date")), path, by_symbol=True)
    else:
        S.write_csv(p.select(F.date_format("ts", "yyyyMMdd").alias("date"), "symbol", "close", "volume"), path)


def _store(spark, d, *names):
    """A store of the weekly panel; each dataset is written once per session, when a query first asks for it."""
    root = _STORES.setdefault((spark.sparkContext.applicationId, d), shared_dir(spark, "store"))
    todo = [n for n in names if (root, n) not in _WRITTEN]
    p = weekly_panel(spark, d) if todo else None
    if len(todo) > 1:
        p = durable(p)
    for n in todo:
        _write(spark, root, n, p)
        _WRITTEN.add((root, n))
    return S.DataRoot(spark, root)


@add("store_discovery", """SELECT name, keys, count(*) FILTER (WHERE l_linenumber > 0) > 0 AS present FROM (VALUES
  ('daily', 'date'), ('factor_frame', 'date'), ('index', 'date'), ('ticks', 'date'), ('actions', 'date,symbol'), ('bars_1w', 'date')) v(name, keys), lineitem GROUP BY name, keys""")
def discovery(spark, d):
    root = _store(spark, d, *DATASETS)
    rows = [(n, ",".join(root.hive_keys(n)), root.read(n).limit(1).count() > 0) for n in root.available()]
    return spark.createDataFrame(rows, "name string, keys string, present boolean")


@add("store_registered_view", f"WITH {panel_sql()} SELECT industry, count(*) AS n, {r('sum(volume)', 'volume', 2)} FROM panel GROUP BY industry")
def registered(spark, d):
    _store(spark, d, "daily").register()
    return rounded(spark.sql("SELECT industry, count(*) AS n, sum(volume) AS volume FROM daily GROUP BY industry"), 2)


@add("store_load_daily", f"""WITH {panel_sql()} SELECT ts, symbol, {r('ln(close)', 'close')}, volume FROM panel
WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30' AND symbol IN ('000001', '000007', '000042')""")
def load_daily(spark, d):
    df = S.load_daily(_store(spark, d, "daily").read("daily"), ["close", "volume"], start="1996-01-01", end="1997-06-30",
                      symbols=["000001", "000007", "000042"])
    return rounded(df.withColumn("close", F.log("close")))


@add("store_load_bars", f"""WITH {panel_sql()} SELECT ts, symbol, {', '.join(r(f'ln({c})', c) for c in ('open', 'high', 'low', 'close', 'volume', 'amount', 'vwap'))} FROM panel
WHERE ts IN (TIMESTAMP '1996-01-01', TIMESTAMP '1999-03-01')""")
def load_bars(spark, d):
    df = S.load_bars(_store(spark, d, "bars_1w").read("bars_1w"), dates=["1996-01-01", "1999-03-01"])
    return rounded(df.select("ts", "symbol", *[F.log(c).alias(c) for c in S.BAR_FIELDS]))


@add("store_load_factor_frame", f"""WITH {panel_sql()}, f AS (SELECT ts, symbol, -(close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts) - 1) AS rev_5 FROM panel)
SELECT ts, symbol, {r('rev_5', 'rev_5')} FROM f WHERE ts >= TIMESTAMP '2000-01-01'""")
def load_factors(spark, d):
    root = _store(spark, d, "factor_frame")
    actual = S.Fingerprint.load(spark, root.path("factor_frame"))
    want = S.Fingerprint.of([S.FactorSpec("rev_5", {"n": 5}), S.FactorSpec("vol_20", {"n": 20}), "size"], "weekly")
    df = S.load_factor_frame(root.read("factor_frame"), ["rev_5"], expected=want, actual=actual, start="2000-01-01")
    return rounded(df)


@add("store_load_index", f"WITH {panel_sql()} SELECT ts, 'EW.ALL' AS symbol, {r('avg(close)', 'close', 6)} FROM panel GROUP BY ts")
def load_index(spark, d):
    return rounded(S.load_index(_store(spark, d, "index").read("index"), "EW.ALL"), 6)


@add("store_load_ticks", f"WITH {panel_sql()} SELECT ts, symbol, {r('ln(close)', 'last')}, volume FROM panel WHERE ts = TIMESTAMP '1996-05-06'")
def load_ticks(spark, d):
    df = S.load_ticks(_store(spark, d, "ticks").read("ticks"), "1996-05-06", allow_full_day=True)
    return rounded(df.withColumn("last", F.log("last")))


@add("store_stream_ticks", f"WITH {panel_sql()} SELECT ts, count(*) AS n, {r('sum(volume)', 'volume', 2)} FROM panel GROUP BY ts")
def stream_ticks(spark, d):
    root = _store(spark, d, "ticks")
    all_rows = run_available(S.stream_ticks(spark, root.path("ticks"), max_files=40))
    return rounded(all_rows.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume")), 2)


@add("store_partition_symbol_strings", f"WITH {panel_sql()} SELECT ts, symbol, strftime(date_trunc('year', ts), '%Y%m%d') AS date, {r('ln(close)', 'close')} FROM panel")
def symbol_strings(spark, d):
    df = _store(spark, d, "actions").read("actions")
    return rounded(df.select("ts", "symbol", "date", F.log("close").alias("close")))


@add("store_csv_round_trip", f"WITH {panel_sql()} SELECT strftime(ts, '%Y%m%d') AS date, symbol, {r('ln(close)', 'close')}, volume FROM panel")
def csv(spark, d):
    root = _store(spark, d, "raw_csv")
    df = S.read_csv(spark, f"{root.root}/raw_csv", "date string, symbol string, close double, volume double")
    return rounded(df.withColumn("close", F.log("close")))


# ------------------------------------------------------------------ committed store

_COMMITTED: dict[tuple, str] = {}


def _committed(spark, d):
    """Months written by three writers whose schemas differ, then the months of 1998 written again."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _COMMITTED:
        path = shared_dir(spark, "committed")
        # staged: four writes read it
        p = durable(weekly_panel(spark, d).select("ts", "symbol", "close", "volume", "industry"))
        p = p.withColumn("date", F.date_format(F.trunc(F.to_date("ts"), "month"), "yyyyMMdd"))
        store, year = Store(spark, path), F.year("ts")
        store.write(p.where(year < 1997).select("date", "ts", "symbol", "close", F.col("volume").cast("bigint").alias("volume")))
        store.write(p.where((year >= 1997) & (year < 1999)).select("date", "ts", "symbol", "close", "volume", "industry"))
        store.write(p.where(year >= 1999).select("date", "ts", "symbol", "close", "industry"))
        store.write(p.where(year == 1998).select("date", "ts", "symbol", (2 * F.col("close")).alias("close"), "volume", "industry"), files_per_date=2)
        _COMMITTED[key] = path
    return Store(spark, _COMMITTED[key])


_MONTH = "strftime(date_trunc('month', ts), '%Y%m%d')"


@add("store_schema_drift", f"""WITH {panel_sql()}, mo AS (SELECT DISTINCT {_MONTH} AS date FROM panel)
SELECT min(date) AS date, 'industry' AS "column", 'added' AS change, CAST(NULL AS VARCHAR) AS before, 'string' AS after FROM mo WHERE date >= '19970101'
UNION ALL SELECT min(date), 'volume', 'retyped', 'bigint', 'double' FROM mo WHERE date >= '19970101'
UNION ALL SELECT min(date), 'volume', 'removed', 'double', NULL FROM mo WHERE date >= '19990101'""")
def schema_drift(spark, d):
    return _committed(spark, d).drift()


@add("store_evolved_read", f"""WITH {panel_sql()} SELECT {_MONTH} AS date, ts, symbol, {r('ln(CASE WHEN year(ts) = 1998 THEN 2 * close ELSE close END)', 'close')},
  {r('CASE WHEN year(ts) < 1999 THEN volume END', 'volume')}, CASE WHEN year(ts) >= 1997 THEN industry END AS industry FROM panel""")
def evolved_read(spark, d):
    df = _committed(spark, d).read(["ts", "symbol", "close", "volume", "industry"])
    return rounded(df.withColumn("close", F.log("close")))


@add("store_as_of_commit", f"""WITH {panel_sql()} SELECT year(ts) AS year, count(*) AS n_rows, {r('sum(ln(close))', 'log_close', 6)} FROM panel GROUP BY year(ts)""")
def as_of_commit(spark, d):
    df = _committed(spark, d).read(["ts", "close"], version=3)
    return rounded(df.groupBy(F.year("ts").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.log("close")).alias("log_close")), 6)


@add("store_manifest", f"""WITH {panel_sql()} SELECT {_MONTH} AS date, count(*) AS n_rows FROM panel GROUP BY 1""")
def manifest(spark, d):
    return _committed(spark, d).manifest().select("date", "n_rows")
