"""Queries that run a Structured Streaming job to the end of the available input."""

from pyspark.sql import functions as F

from ...functions.ordered import shared_dir
from ...sources.panels import order_events, tick_stream
from ...streaming import jobs as J
from .base import Catalog, r, rounded
from .microstructure import _BOOK, _ROUTE, _SLOT_COLS, HOUR, SLOTS, TICKS

CATALOG = Catalog()
add = CATALOG.add


def _ns(df, col="slot"):
    return df.withColumn(col, F.unix_micros(col) * 1000)


@add("stream_slot_bars", f"""WITH {TICKS},
b AS (SELECT (arrival_ts // {HOUR} + 1) * {HOUR} AS slot, * FROM tk)
SELECT slot, symbol, count(*) FILTER (WHERE record_type = 'trade') AS n_trades, CAST(coalesce(sum(volume) FILTER (WHERE record_type = 'trade'), 0) AS BIGINT) AS volume,
  {r("coalesce(sum(price * volume) FILTER (WHERE record_type = 'trade'), 0)", 'amount', 4)}, {r("sum(price * volume) FILTER (WHERE record_type = 'trade') / greatest(sum(volume) FILTER (WHERE record_type = 'trade'), 1e-12)", 'vwap', 7)},
  {r("arg_max(price, seq_id) FILTER (WHERE record_type = 'trade')", 'close')}, {r("max(price) FILTER (WHERE record_type = 'trade')", 'high')}, {r("min(price) FILTER (WHERE record_type = 'trade')", 'low')},
  CAST(coalesce(sum(volume) FILTER (WHERE record_type = 'trade' AND side = 'buy'), 0) AS BIGINT) AS buy_vol, CAST(coalesce(sum(volume) FILTER (WHERE record_type = 'trade' AND side = 'sell'), 0) AS BIGINT) AS sell_vol,
  count(*) FILTER (WHERE record_type = 'add') AS n_add, count(*) FILTER (WHERE record_type = 'cancel') AS n_cancel,
  CAST(coalesce(sum(volume) FILTER (WHERE record_type = 'add'), 0) AS BIGINT) AS add_vol, CAST(coalesce(sum(volume) FILTER (WHERE record_type = 'cancel'), 0) AS BIGINT) AS cancel_vol
FROM b GROUP BY slot, symbol""")
def slot_bars(spark, d):
    bars = J.run_available(J.slot_bars(tick_stream(spark, d), width="1 hour", delay="2 hours"), final_by=("slot", "symbol"))
    return rounded(_ns(bars), 8, amount=4, vwap=7)


@add("stream_latency_monitor", f"""WITH {TICKS},
b AS (SELECT (arrival_ts // {HOUR} + 1) * {HOUR} AS slot, * FROM tk)
SELECT slot, exchange, count(*) AS n, {r('avg(arrival_ts - exchange_ts)', 'mean_latency', 2)}, max(arrival_ts - exchange_ts) AS max_latency,
  CAST(1 AS DOUBLE) AS causal_share FROM b GROUP BY slot, exchange""")
def latency(spark, d):
    m = J.run_available(J.latency_monitor(tick_stream(spark, d), width="1 hour", delay="2 hours"), final_by=("slot", "exchange"))
    return rounded(_ns(m), 2)


@add("stream_gap_monitor", f"""WITH {TICKS}, pv AS (SELECT channel_id, seq_id, coalesce(lag(seq_id) OVER (PARTITION BY channel_id ORDER BY seq_id), 0) AS prev FROM tk)
SELECT channel_id, prev + 1 AS first_missing, seq_id - 1 AS last_missing, 'open' AS event FROM pv WHERE seq_id > prev + 1""")
def gaps(spark, d):
    return J.run_available(J.gap_monitor(tick_stream(spark, d)))


def _rocksdb(spark, job):
    """Run a job with the state store that its operators need."""
    old = spark.conf.get(J.PROVIDER_CONF)
    spark.conf.set(J.PROVIDER_CONF, J.ROCKSDB)
    try:
        return job()
    finally:
        spark.conf.set(J.PROVIDER_CONF, old)


def _two_streams(spark, d):
    """Order and trade streams of the tick stream: Shenzhen cancels ride the trade stream."""
    t = tick_stream(spark, d)
    rides = (F.col("record_type") == "trade") | ((F.col("record_type") == "cancel") & (F.col("exchange") == "XSHE"))
    orders = t.where(~rides & F.col("record_type").isin("add", "cancel"))
    trades = tick_stream(spark, d).where(rides)
    return [J.with_heartbeat(x, "2100-01-01") for x in (orders, trades)]


@add("stream_flow_bars", f"WITH {TICKS} {_ROUTE} {SLOTS} SELECT {_SLOT_COLS} FROM slt")
def flow_bars(spark, d):
    orders, trades = _two_streams(spark, d)
    bars = _rocksdb(spark, lambda: J.run_available(J.flow_bars(orders, trades, width="1 hour", order_delay="2 hours", trade_delay="1 hour")))
    return rounded(_ns(bars), 6)


# a trade names the records one and two before it; few of them are adds of the hours before
@add("stream_linked_trades", f"""WITH {TICKS}, lg AS (SELECT exchange, seq_id, price, arrival_ts, unnest(['buy', 'sell']) AS leg, unnest([seq_id - 1, seq_id - 2]) AS ref FROM tk WHERE record_type = 'trade')
SELECT lg.exchange, lg.seq_id, leg, ref, {r('lg.price', 'price')}, {r('a.price', 'order_price')}, lg.arrival_ts - a.arrival_ts AS wait_ns FROM lg
LEFT JOIN tk a ON a.record_type = 'add' AND a.exchange = lg.exchange AND a.seq_id = ref AND a.arrival_ts <= lg.arrival_ts AND a.arrival_ts >= lg.arrival_ts - 7200000000000
WHERE ref <> 0""")
def linked_trades(spark, d):
    orders, trades = _two_streams(spark, d)
    trades = trades.withColumn("buy_seq_id", F.col("seq_id") - 1).withColumn("sell_seq_id", F.col("seq_id") - 2)
    out = _rocksdb(spark, lambda: J.run_available(J.linked_trades(orders, trades, within="2 hours", order_delay="2 hours", trade_delay="1 hour")))
    return rounded(out)


# a hole is lost 20 hours after the record that shows it, unless the stream ends within the watermark's hour before
@add("stream_gap_timeline", f"""WITH {TICKS}, pv AS (SELECT channel_id, seq_id, arrival_ts, coalesce(lag(seq_id) OVER (PARTITION BY channel_id ORDER BY seq_id), 0) AS prev,
  max(arrival_ts) OVER () AS last FROM tk),
h AS (SELECT channel_id, prev + 1 AS first_missing, seq_id - 1 AS last_missing, arrival_ts // 1000000 AS ms, last // 1000000 AS last FROM pv WHERE seq_id > prev + 1)
SELECT channel_id, first_missing, last_missing, 'open' AS event FROM h
UNION ALL SELECT channel_id, first_missing, last_missing, 'lost' FROM h WHERE ms + 72000000 <= last - 3600000""")
def gap_timeline(spark, d):
    t = tick_stream(spark, d)
    out = _rocksdb(spark, lambda: J.run_available(J.gap_timeline(t, patience="20 hours", delay="1 hour", block=4096)))
    return out.select("channel_id", "first_missing", "last_missing", "event")


@add("stream_drop_replayed", f"""WITH {TICKS} SELECT channel_id, seq_id, symbol, record_type FROM tk""")
def replayed(spark, d):
    t = tick_stream(spark, d)
    # every record arrives twice
    twice = t.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return J.run_available(J.drop_replayed(twice)).select("channel_id", "seq_id", "symbol", "record_type")


@add("stream_book", f"""{_BOOK},
o AS (SELECT bk.* FROM bk JOIN fl USING (symbol, slot))
SELECT slot, symbol, exchange, {r('best_bid', 'best_bid')}, {r('best_ask', 'best_ask')}, bid_qty, ask_qty, bid_depth5, ask_depth5, n_bid_orders, n_ask_orders, bid_levels, ask_levels,
  slot_trades, slot_qty, slot_buy_qty, slot_sell_qty, unresolved FROM o""")
def book(spark, d):
    # references are resolved in batch; the events are then replayed as a stream
    root = shared_dir(spark, "book")
    events = order_events(spark, d)
    events.write.mode("overwrite").parquet(f"{root}/events")
    s = J.with_heartbeat(J.stream_table(spark, f"{root}/events", events), "4102444800000000000", time_col="arrival_ts")
    return rounded(_rocksdb(spark, lambda: J.run_available(J.book_stream(s, HOUR))))
