"""Queries for tick normalisation, audits, slots, order books and flow features."""

from pyspark.sql import functions as F

from ...functions import ticks as K
from ...functions.columns import ratio
from ...operators import book as BK
from ...operators import features_flow as FF
from ...operators import slots as S
from ...operators import tick_audit as T
from ...operators.labels import forward_returns
from ...sources.panels import order_events, split_streams, table, ticks
from .base import Catalog, forward_sql, r, rounded, slots_sql

CATALOG = Catalog()
add = CATALOG.add

HOUR = 3600 * 10**9

TICKS = """tk AS (SELECT event_id AS seq_id, user_id % 14 AS channel_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS symbol,
  CASE WHEN user_id % 14 < 7 THEN 'XSHG' ELSE 'XSHE' END AS exchange, ts, epoch_us(ts) * 1000 AS arrival_ts,
  epoch_us(ts) * 1000 - (event_id % 97) * 1000000 AS exchange_ts,
  CASE WHEN event_type IN ('signup', 'view') THEN 'add' WHEN event_type = 'click' THEN 'cancel' WHEN event_type = 'purchase' THEN 'trade' ELSE 'status' END AS record_type,
  10 + CAST(json_extract(props, '$.k') AS BIGINT) / 100 AS price, CAST(round(value * 100) AS BIGINT) AS volume,
  CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CAST(event_id % 3 AS INT) AS order_type FROM events)"""

# ------------------------------------------------------------------ normalisation


@add("tick_scaling", f"""WITH {TICKS}
SELECT seq_id, {r("volume / CASE exchange WHEN 'XSHG' THEN 1e5 ELSE 1e4 END", 'px')}, {r("volume / CASE exchange WHEN 'XSHG' THEN 1e3 ELSE 1e2 END", 'qty')},
  {r("volume / CASE exchange WHEN 'XSHG' THEN 1e2 ELSE 1e4 END", 'amt')}, CAST(round_even(price * CASE exchange WHEN 'XSHG' THEN 1e5 ELSE 1e4 END, 0) AS BIGINT) AS int_price,
  {r("round_even(price * CASE exchange WHEN 'XSHG' THEN 1e5 ELSE 1e4 END, 0) / CASE exchange WHEN 'XSHG' THEN 1e5 ELSE 1e4 END", 'tick_price')} FROM tk""")
def scaling(spark, d):
    ex, v, p = F.col("exchange"), F.col("volume"), F.col("price")
    return rounded(ticks(spark, d).select(
        "seq_id", K.to_price(v, ex).alias("px"), K.to_quantity(v, ex).alias("qty"), K.to_amount(v, ex).alias("amt"),
        K.from_vendor_price(p, ex).alias("int_price"), K.snap_price(p, ex).alias("tick_price")))


@add("tick_codes", """SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS symbol,
  CASE o_orderkey % 3 WHEN 0 THEN 'XSHG' WHEN 1 THEN 'XSHE' END AS exchange, CASE o_custkey % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' END AS side,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE o_custkey % 4 WHEN 1 THEN 'add' WHEN 2 THEN 'cancel' ELSE 'status' END
    ELSE CASE o_custkey % 4 WHEN 1 THEN 'trade' WHEN 2 THEN 'cancel' ELSE 'status' END END AS record_type,
  CASE WHEN left(CAST(o_orderkey AS VARCHAR), 1) IN ('5', '6', '9') THEN 'XSHG' ELSE 'XSHE' END AS guessed,
  CASE o_orderkey % 3 WHEN 0 THEN '.SH' ELSE '.SZ' END AS suffix FROM orders""")
def codes(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    market = F.when(o % 3 == 0, 3553).when(o % 3 == 1, 3554).otherwise(9)
    side = F.when(c % 3 == 0, 1063).when(c % 3 == 1, 1550).otherwise(0)
    stream = F.when(o % 2 == 0, "order").otherwise("trade")
    return table(spark, d, "orders").select(
        "o_orderkey", K.symbol_of(c).alias("symbol"), K.venue_of(market).alias("exchange"), K.side_of(side).alias("side"),
        K.record_type_of(stream, c % 4, c % 4).alias("record_type"), K.venue_of_symbol(o.cast("string")).alias("guessed"),
        K.suffix_of(K.venue_of(market)).alias("suffix"))


@add("tick_exec_types", """SELECT o_orderkey, CASE WHEN s = 'order' THEN CASE WHEN e = '0' THEN 'add' WHEN x = 'XSHG' AND e = '4' THEN 'cancel' ELSE 'status' END
  ELSE CASE WHEN e = 'F' THEN 'trade' WHEN x = 'XSHE' AND e = '4' THEN 'cancel' ELSE 'status' END END AS record_type, c IN ('1', '2') AS directional
FROM (SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'XSHG' ELSE 'XSHE' END AS x, CASE o_custkey % 2 WHEN 0 THEN 'order' ELSE 'trade' END AS s,
  CASE o_orderkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '4' WHEN 2 THEN 'F' ELSE 'Z' END AS e, CASE o_custkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'G' ELSE 'F' END AS c FROM orders)""")
def exec_types(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    x = F.when(o % 2 == 0, "XSHG").otherwise("XSHE")
    s = F.when(c % 2 == 0, "order").otherwise("trade")
    e = F.when(o % 5 == 0, "0").when(o % 5 == 1, "4").when(o % 5 == 2, "F").otherwise("Z")
    side = F.when(c % 4 == 0, "1").when(c % 4 == 1, "2").when(c % 4 == 2, "G").otherwise("F")
    return table(spark, d, "orders").select("o_orderkey", K.record_type_of_exec(x, s, e).alias("record_type"),
                                            K.is_directional(side).alias("directional"))


@add("tick_decode_time", """SELECT event_id, date_trunc('millisecond', ts) AS sse, date_trunc('millisecond', ts) AS szse FROM events""")
def decode_time(spark, d):
    ts = F.col("ts")
    day = (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("bigint")
    ms = F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("bigint")
    clock = F.hour(ts).cast("bigint") * 10_000_000 + F.minute(ts) * 100_000 + ms
    return table(spark, d, "events").select(
        "event_id", K.decode_sse_time(day, clock).alias("sse"), K.decode_szse_time(day * 1_000_000_000 + clock).alias("szse"))


@add("tick_phase_flags", """SELECT o_orderkey, f AS phase, CASE WHEN sse THEN substring(s, 2, 1) = '1' ELSE f NOT IN ('P', 'N') END AS can_trade,
  CASE WHEN sse THEN substring(s, 3, 1) <> '0' ELSE true END AS is_listed, CASE WHEN sse THEN substring(s, 4, 1) = '1' ELSE f IN ('T', 'C', 'U') END AS accepts_orders,
  f IN ('P', 'N') AS is_halted, f IN ('C', 'U', 'M') AS is_auction,
  f IN ('T', 'C', 'U') AND CASE WHEN sse THEN substring(s, 2, 1) = '1' AND substring(s, 3, 1) <> '0' ELSE true END AS is_tradable
FROM (SELECT *, CASE WHEN contains('SCTEPMNU', left(s, 1)) THEN left(s, 1) ELSE '?' END AS f FROM (
  SELECT o_orderkey, o_orderkey % 2 = 0 AS sse, rpad(substring('SCTEPMNUX', CAST(o_custkey % 9 + 1 AS BIGINT), 1) || CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 2 AS VARCHAR) || CAST(o_custkey % 2 AS VARCHAR) || '1' ELSE '' END, 4, ' ') AS s
  FROM (SELECT o_custkey, o_orderkey // 3 AS o_orderkey, o_orderkey AS k FROM orders) WHERE true))""".replace("SELECT o_orderkey, f AS phase", "SELECT k AS o_orderkey, f AS phase").replace("SELECT o_orderkey, o_orderkey % 2 = 0 AS sse", "SELECT k, k % 2 = 0 AS sse"))
def phase_flags(spark, d):
    k, o, c = F.col("o_orderkey"), F.call_function("div", F.col("o_orderkey"), F.lit(3)), F.col("o_custkey")
    first = F.expr("substring('SCTEPMNUX', int(o_custkey % 9 + 1), 1)")
    code = F.concat(first, F.when(o % 5 > 0, F.concat((o % 2).cast("string"), (c % 2).cast("string"), F.lit("1"))).otherwise(""))
    ex = F.when(k % 2 == 0, "XSHG").otherwise("XSHE")
    return table(spark, d, "orders").select("o_orderkey", K.phase_flags(code, ex).alias("p")).select("o_orderkey", "p.*")


_BROKER = "CASE WHEN seq_id % 11 = 0 THEN arrival_ts + 5 WHEN seq_id % 13 = 0 THEN NULL ELSE exchange_ts END"


@add("tick_point_in_time", f"""WITH {TICKS}, b AS (SELECT *, {_BROKER} AS broker_ts, CASE WHEN seq_id % 17 <> 0 THEN arrival_ts END AS arr FROM tk)
SELECT seq_id, coalesce(arr, exchange_ts) AS pit, arr - exchange_ts AS latency, arr IS NULL OR (arr >= exchange_ts AND (broker_ts IS NULL OR (exchange_ts <= broker_ts AND broker_ts <= arr))) AS causal FROM b""")
def point_in_time(spark, d):
    t = _with_broker(ticks(spark, d)).withColumn("arr", F.when(F.col("seq_id") % 17 != 0, F.col("arrival_ts")))
    ex, b, a = F.col("exchange_ts"), F.col("broker_ts"), F.col("arr")
    return t.select("seq_id", K.pit_timestamp(a, ex).alias("pit"), K.wire_latency(a, ex).alias("latency"), K.is_causal(ex, b, a).alias("causal"))


def _with_broker(t):
    s = F.col("seq_id")
    return t.withColumn("broker_ts", F.when(s % 11 == 0, F.col("arrival_ts") + 5).when(s % 13 == 0, F.lit(None)).otherwise(F.col("exchange_ts")))


def _raw(spark, d):
    """Vendor-shaped records: integer codes and millisecond stamps."""
    t = ticks(spark, d)
    s = F.col("seq_id")
    return t.select(
        (F.call_function("div", F.col("exchange_ts"), F.lit(1_000_000))).alias("time"),
        F.call_function("div", F.col("arrival_ts"), F.lit(1_000_000)).alias("spider_ts"), F.lit(None).cast("bigint").alias("server_ts"),
        F.col("symbol").cast("int").alias("symbol_id"), F.when(s % 10 == 0, 1).when(F.col("exchange") == "XSHG", 3553).otherwise(3554).alias("market_id"),
        F.when(F.col("record_type") == "add", 1).when(F.col("record_type") == "cancel", 2).otherwise(5).alias("update_type"),
        "price", "volume", F.when(F.col("side") == "buy", 1063).otherwise(1550).alias("dir"), "channel_id", "seq_id",
        s.alias("order_id"), "order_type")


@add("tick_normalise_records", f"""WITH {TICKS}
SELECT exchange_ts // 1000000 * 1000000 AS exchange_ts, arrival_ts // 1000000 * 1000000 AS arrival_ts, CAST(0 AS BIGINT) AS broker_ts, symbol,
  CASE WHEN seq_id % 10 <> 0 THEN exchange END AS exchange, CASE WHEN record_type IN ('add', 'cancel') THEN record_type ELSE 'status' END AS record_type,
  {r('price', 'price_raw')}, CASE WHEN seq_id % 10 <> 0 THEN CAST(round_even(price * CASE exchange WHEN 'XSHG' THEN 1e5 ELSE 1e4 END, 0) AS BIGINT) END AS price,
  volume, side, channel_id, seq_id, seq_id AS order_id, CAST(order_type AS BIGINT) AS order_type FROM tk""")
def normalise(spark, d):
    return rounded(T.replay_order(T.normalise_records(_raw(spark, d), "order", "v2_order")))


# ------------------------------------------------------------------ audits

_ROUTE = """,
od AS (SELECT * FROM tk WHERE record_type IN ('add', 'cancel') AND NOT (record_type = 'cancel' AND exchange = 'XSHE')),
td AS (SELECT * FROM tk WHERE record_type = 'trade' OR (record_type = 'cancel' AND exchange = 'XSHE'))"""


@add("tick_sequence_gaps", f"""WITH {TICKS} {_ROUTE},
sq AS (SELECT DISTINCT channel_id, seq_id FROM (SELECT * FROM od UNION ALL SELECT tk.* FROM tk WHERE record_type = 'trade')),
pv AS (SELECT channel_id, seq_id, coalesce(lag(seq_id) OVER (PARTITION BY channel_id ORDER BY seq_id), 0) AS prev FROM sq)
SELECT channel_id, prev + 1 AS first_missing, seq_id - 1 AS last_missing FROM pv WHERE seq_id > prev + 1""")
def gaps(spark, d):
    orders, trades = split_streams(spark, d)
    return T.sequence_gaps([orders, trades.where("record_type = 'trade'")])


@add("tick_hole_counts", f"""WITH {TICKS} {_ROUTE},
w AS (SELECT greatest((SELECT min(exchange_ts) FROM od), (SELECT min(exchange_ts) FROM td)) AS lo, least((SELECT max(exchange_ts) FROM od), (SELECT max(exchange_ts) FROM td)) AS hi),
u AS (SELECT channel_id, seq_id, 'o' AS s FROM od, w WHERE seq_id <> 0 AND exchange_ts BETWEEN lo AND hi UNION ALL SELECT channel_id, seq_id, 't' FROM td, w WHERE seq_id <> 0 AND exchange_ts BETWEEN lo AND hi)
SELECT channel_id, count(DISTINCT seq_id) FILTER (WHERE s = 'o') AS order_n, coalesce(max(seq_id) FILTER (WHERE s = 'o') - min(seq_id) FILTER (WHERE s = 'o') + 1 - count(DISTINCT seq_id) FILTER (WHERE s = 'o'), 0) AS order_gaps,
  count(DISTINCT seq_id) FILTER (WHERE s = 't') AS trade_n, coalesce(max(seq_id) FILTER (WHERE s = 't') - min(seq_id) FILTER (WHERE s = 't') + 1 - count(DISTINCT seq_id) FILTER (WHERE s = 't'), 0) AS trade_gaps,
  count(DISTINCT seq_id) AS merged_n, max(seq_id) - min(seq_id) + 1 - count(DISTINCT seq_id) AS merged_gaps FROM u GROUP BY channel_id""")
def holes(spark, d):
    orders, trades = split_streams(spark, d)
    return T.hole_counts(orders, trades)


@add("tick_latency_profile", f"""WITH {TICKS}, b AS (SELECT *, {_BROKER} AS broker_ts FROM tk),
l AS (SELECT record_type, 'wire' AS leg, arrival_ts - exchange_ts AS v FROM b UNION ALL SELECT record_type, 'broker', arrival_ts - broker_ts FROM b WHERE broker_ts IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY record_type, leg ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY record_type, leg) AS n FROM l)
SELECT record_type, leg, max(n) AS n, max(v) FILTER (WHERE i = least(n - 1, CAST(floor(n * 0.5) AS BIGINT))) AS median, max(v) FILTER (WHERE i = least(n - 1, CAST(floor(n * 0.9) AS BIGINT))) AS p90,
  max(v) FILTER (WHERE i = least(n - 1, CAST(floor(n * 0.99) AS BIGINT))) AS p99, max(v) AS max, {r('avg(v)', 'mean', 2)} FROM k GROUP BY record_type, leg""")
def latency(spark, d):
    t = _with_broker(ticks(spark, d))
    return rounded(T.latency_profile(t, {"wire": ("exchange_ts", "arrival_ts"), "broker": ("broker_ts", "arrival_ts")}), 2)


@add("tick_causality_share", f"""WITH {TICKS}, b AS (SELECT *, {_BROKER} AS broker_ts FROM tk)
SELECT record_type, count(*) AS n, {r('avg(CASE WHEN broker_ts <= arrival_ts THEN 1.0 ELSE 0.0 END)', 'broker_first')},
  {r('avg(CASE WHEN exchange_ts <= broker_ts AND broker_ts <= arrival_ts THEN 1.0 ELSE 0.0 END)', 'causal')} FROM b WHERE broker_ts IS NOT NULL GROUP BY record_type""")
def causality(spark, d):
    return rounded(T.causality_share(_with_broker(ticks(spark, d))))


@add("tick_feed_profile", f"""WITH {TICKS}, p AS (SELECT *, price * CASE exchange WHEN 'XSHG' THEN 1e5 ELSE 1e4 END AS x, CASE WHEN record_type = 'trade' THEN 'trade' ELSE 'order' END AS stream FROM tk)
SELECT stream, count(*) AS n_records, count(*) FILTER (WHERE exchange = 'XSHG') AS n_xshg, count(*) FILTER (WHERE exchange = 'XSHE') AS n_xshe, CAST(0 AS BIGINT) AS n_other_venue,
  count(*) FILTER (WHERE record_type = 'add') AS n_add, count(*) FILTER (WHERE record_type = 'cancel') AS n_cancel, count(*) FILTER (WHERE record_type = 'trade') AS n_trade, count(*) FILTER (WHERE record_type = 'status') AS n_status,
  count(*) FILTER (WHERE record_type = 'cancel' AND exchange = 'XSHG') AS n_cancel_xshg, count(*) FILTER (WHERE record_type = 'cancel' AND exchange = 'XSHE') AS n_cancel_xshe,
  count(*) AS n_priced, count(*) FILTER (WHERE floor(x) <> round_even(x, 0)) AS n_lossy, count(*) AS n_stamped, CAST(0 AS BIGINT) AS n_skewed, min(exchange_ts) AS first_ns, max(exchange_ts) AS last_ns,
  {r('count(*) FILTER (WHERE floor(x) <> round_even(x, 0)) / count(*)', 'lossy_share')}, true AS unit_plausible FROM p GROUP BY stream""")
def feed(spark, d):
    t = ticks(spark, d).withColumn("stream", F.when(F.col("record_type") == "trade", "trade").otherwise("order"))
    return rounded(T.feed_profile(t))


_LINK = """,
lo AS (SELECT exchange, record_type, seq_id, CASE exchange WHEN 'XSHG' THEN seq_id * 3 ELSE seq_id END AS order_id FROM od),
lt AS (SELECT exchange, CASE WHEN seq_id % 9 = 0 THEN 0 ELSE (seq_id - 1) * CASE exchange WHEN 'XSHG' THEN 3 ELSE 1 END END AS b, CASE WHEN seq_id % 9 = 0 THEN 0 ELSE (seq_id - 2) * CASE exchange WHEN 'XSHG' THEN 3 ELSE 1 END END AS s FROM tk WHERE record_type = 'trade')"""


def _linkage(spark, d):
    orders, _ = split_streams(spark, d)
    k = F.when(F.col("exchange") == "XSHG", 3).otherwise(1)
    orders = orders.withColumn("order_id", F.col("seq_id") * k)
    t = ticks(spark, d).where("record_type = 'trade'")
    ref = lambda back: F.when(F.col("seq_id") % 9 == 0, 0).otherwise((F.col("seq_id") - back) * k)
    return orders, t.withColumns({"buy_seq_id": ref(1), "sell_seq_id": ref(2)})


@add("tick_linkage_hit_rates", f"""WITH {TICKS} {_ROUTE} {_LINK},
ids AS (SELECT DISTINCT exchange, 'order_id' AS candidate, order_id AS id FROM lo UNION ALL SELECT DISTINCT exchange, 'seq_id', seq_id FROM lo),
cd AS (SELECT * FROM (VALUES ('order_id'), ('seq_id')) v(candidate)),
h AS (SELECT lt.exchange, candidate, count(*) AS n_trades, avg(CASE WHEN NOT (b = 0 AND s = 0) AND EXISTS (SELECT 1 FROM ids i WHERE i.exchange = lt.exchange AND i.candidate = cd.candidate AND i.id = b) THEN 1.0 ELSE 0.0 END) AS br,
  avg(CASE WHEN NOT (b = 0 AND s = 0) AND EXISTS (SELECT 1 FROM ids i WHERE i.exchange = lt.exchange AND i.candidate = cd.candidate AND i.id = s) THEN 1.0 ELSE 0.0 END) AS sr FROM lt, cd GROUP BY lt.exchange, candidate)
SELECT exchange, candidate, n_trades, {r('br', 'buy_rate')}, {r('sr', 'sell_rate')}, least(br, sr) > 0.3 AS is_key FROM h""")
def linkage(spark, d):
    o, t = _linkage(spark, d)
    return rounded(T.linkage_hit_rates(o, t, ["order_id", "seq_id"], threshold=0.3))


@add("tick_cancel_overlap", f"""WITH {TICKS} {_ROUTE}, x AS (SELECT exchange, seq_id // 4 AS g, bool_or(record_type = 'add') AS a, bool_or(record_type = 'cancel') AS c FROM od GROUP BY ALL)
SELECT exchange, count(*) FILTER (WHERE c) AS n_cancel_ids, count(*) FILTER (WHERE a AND c) AS n_shared FROM x GROUP BY exchange""")
def cancel_overlap(spark, d):
    o, _ = split_streams(spark, d)
    return T.cancel_overlap(o.withColumn("seq_id", F.call_function("div", F.col("seq_id"), F.lit(4))))


# ------------------------------------------------------------------ slots and flow

SLOTS = f""",
rt AS (SELECT * FROM od UNION ALL SELECT * REPLACE (0 AS order_type) FROM td WHERE record_type = 'cancel'),
ta AS (SELECT (arrival_ts // {HOUR} + 1) * {HOUR} AS slot, symbol, count(*) AS n_trades, CAST(sum(volume) AS BIGINT) AS volume, sum(price * volume) AS amount,
  arg_max(price, seq_id) AS close, max(price) AS high, min(price) AS low, max(volume) AS max_trade, CAST(coalesce(sum(volume) FILTER (WHERE side = 'buy'), 0) AS BIGINT) AS buy_vol,
  CAST(coalesce(sum(volume) FILTER (WHERE side = 'sell'), 0) AS BIGINT) AS sell_vol, count(*) FILTER (WHERE side = 'buy') AS n_buy, count(*) FILTER (WHERE side = 'sell') AS n_sell
  FROM td WHERE record_type = 'trade' GROUP BY ALL),
oa AS (SELECT (arrival_ts // {HOUR} + 1) * {HOUR} AS slot, symbol, count(*) FILTER (WHERE record_type = 'add') AS n_add, count(*) FILTER (WHERE record_type = 'cancel') AS n_cancel,
  sum(volume) FILTER (WHERE record_type = 'add') AS add_vol, sum(volume) FILTER (WHERE record_type = 'cancel') AS cancel_vol,
  sum(volume) FILTER (WHERE record_type = 'add' AND side = 'buy') AS buy_add_vol, sum(volume) FILTER (WHERE record_type = 'add' AND side = 'sell') AS sell_add_vol,
  sum(volume) FILTER (WHERE record_type = 'cancel' AND side = 'buy') AS buy_cancel_vol, sum(volume) FILTER (WHERE record_type = 'cancel' AND side = 'sell') AS sell_cancel_vol,
  count(*) FILTER (WHERE record_type = 'add' AND order_type = 1) AS n_market_order FROM rt GROUP BY ALL),
slt AS (SELECT coalesce(t.slot, o.slot) AS slot, coalesce(t.symbol, o.symbol) AS symbol, coalesce(n_trades, 0) AS n_trades, coalesce(volume, 0) AS volume, coalesce(amount, 0) AS amount,
  amount / greatest(volume, 1e-12) AS vwap, close, high, low,
  {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('buy_vol', 'sell_vol', 'n_buy', 'n_sell', 'max_trade'))},
  {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in S.ORDER_COUNTS)} FROM ta t FULL JOIN oa o ON t.slot = o.slot AND t.symbol = o.symbol)"""


def slot_panel(spark, d, width=HOUR):
    orders, trades = split_streams(spark, d)
    o, t = S.route_cancels(orders, trades)
    from ...functions.ordered import measure
    return measure(S.aggregate_to_slots(o, t, slot_ns=width), "symbol", "slot")


_SLOT_COLS = ", ".join(c if c not in ("amount", "vwap", "close", "high", "low") else r(c, c, 6) for c in ("slot", "symbol", *S.SLOT_AGGREGATES))


@add("flow_route_cancels", f"""WITH {TICKS} {_ROUTE} {SLOTS} SELECT record_type, exchange, count(*) AS n, CAST(sum(order_type) AS BIGINT) AS types FROM rt GROUP BY ALL""")
def route(spark, d):
    o, _ = S.route_cancels(*split_streams(spark, d))
    return o.groupBy("record_type", "exchange").agg(F.count(F.lit(1)).alias("n"), F.sum("order_type").alias("types"))


@add("flow_slot_panel", f"WITH {TICKS} {_ROUTE} {SLOTS} SELECT {_SLOT_COLS} FROM slt")
def flow_slots(spark, d):
    return rounded(slot_panel(spark, d), 6)


_FW = "w AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol ORDER BY slot)"


def _m(fn, x):
    return f"(CASE WHEN count({x}) OVER w >= 10 THEN {fn}({x}) OVER w END)"


def _g(x, low="1e-12"):
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest({x}, {low}) END)"


FLOW = f""",
g0 AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM slt),
g1 AS (SELECT *, px / lag(px) OVER s - 1 AS ret, buy_vol - sell_vol AS sv, buy_vol + sell_vol AS tv FROM g0 WINDOW s AS (PARTITION BY symbol ORDER BY slot)),
g2 AS (SELECT *, lag(ret) OVER s AS lr FROM g1 WINDOW s AS (PARTITION BY symbol ORDER BY slot))"""
_FLOW_COLS = {
    "tfi": "sv / greatest(tv, 1e-12)",
    "ofi": "((buy_add_vol - buy_cancel_vol) - (sell_add_vol - sell_cancel_vol)) / greatest(add_vol + cancel_vol, 1e-12)",
    "signed_vol_20": f"{_m('sum', 'sv')} / {_g(_m('sum', 'tv'))}",
    "cancel_ratio": "cancel_vol / greatest(add_vol, 1e-12)",
    "cancel_skew": "(buy_cancel_vol - sell_cancel_vol) / greatest(cancel_vol, 1e-12)",
    "trade_to_order": "n_trades / greatest(n_add, 1e-12)", "market_order_ratio": "n_market_order / greatest(n_add, 1e-12)",
    "order_size_imb": "(buy_add_vol / greatest(n_buy, 1) - sell_add_vol / greatest(n_sell, 1)) / greatest(add_vol / greatest(n_add, 1), 1e-12)",
    "trade_intensity": f"n_trades / {_g(_m('avg', 'n_trades'))}", "avg_trade_size": "volume / greatest(n_trades, 1)",
    "large_trade_share": "max_trade / greatest(volume, 1e-12)", "rv_20": _m("stddev_samp", "ret"),
    "mom_20": "px / lag(px, 20) OVER s - 1", "rev_3": "-(px / lag(px, 3) OVER s - 1)",
    "roll_spread": f"CASE WHEN {_m('avg', '(ret * lr)')} IS NOT NULL THEN 2 * sqrt(greatest(-{_m('avg', '(ret * lr)')}, 0)) END",
    "kyle_lambda": f"({_m('avg', '(ret * sv)')} - {_m('avg', 'ret')} * {_m('avg', 'sv')}) / {_g(_m('var_samp', 'sv'))} * 1e6",
    "amihud": f"{_m('avg', 'abs(ret)')} / {_g(_m('avg', 'amount'))} * 1e6", "vpin": f"{_m('sum', 'abs(sv)')} / {_g(_m('sum', 'tv'))}",
}
# slots without adds divide by 1e-12 and without trades by 1e-12: those ratios are compared on a log scale
_BIG = ("cancel_ratio", "trade_to_order", "market_order_ratio", "order_size_imb")


def _squash(x):
    return f"sign({x}) * ln(1 + abs({x}))"


_FLOW_SQL = ", ".join(r(_squash(f"({e})") if n in _BIG else e, n, 7) for n, e in _FLOW_COLS.items())


@add("feature_flow", f"""WITH {TICKS} {_ROUTE} {SLOTS} {FLOW}
SELECT slot, symbol, {r('px', 'px')}, {r('ret', 'ret')}, {_FLOW_SQL} FROM g2 WINDOW {_FW}""")
def flow_features(spark, d):
    f = FF.build_flow_features(slot_panel(spark, d))
    f = f.withColumns({"kyle_lambda": F.col("kyle_lambda") * 1e6, "amihud": F.col("amihud") * 1e6,
                       **{c: F.signum(c) * F.log(1 + F.abs(c)) for c in _BIG}})
    return rounded(f.select("slot", "symbol", "px", "ret", *FF.FLOW_FEATURES), 7, px=8, ret=8)


@add("feature_flow_label", f"""WITH {TICKS} {_ROUTE} {SLOTS} {FLOW},
tg AS (SELECT slot AS ts, symbol, px FROM g2) {slots_sql('tg', 'sl')} {forward_sql(10, price='px', source='sl', label='y')}
SELECT ts AS slot, symbol, {r('y', 'y')} FROM labelled""")
def flow_label(spark, d):
    f = FF.build_flow_features(slot_panel(spark, d)).select("slot", "symbol", "px")
    return rounded(forward_returns(f, {"y": 10}, "px", ts="slot").select("slot", "symbol", "y"))


# ------------------------------------------------------------------ order book

# the replay stated directly: at every slot, what is left of each order that was added before it
EVENTS = """,
oe0 AS (SELECT *, last_value(CASE WHEN record_type = 'add' AND side = 'buy' THEN seq_id END IGNORE NULLS) OVER q AS lb,
  last_value(CASE WHEN record_type = 'add' AND side = 'sell' THEN seq_id END IGNORE NULLS) OVER q AS ls FROM tk WHERE record_type <> 'status'
  WINDOW q AS (PARTITION BY symbol ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
oe AS (SELECT channel_id, seq_id, arrival_ts, symbol, exchange, record_type AS kind, price, volume AS qty, side,
  CASE record_type WHEN 'add' THEN seq_id WHEN 'cancel' THEN coalesce(CASE side WHEN 'buy' THEN lb ELSE ls END, -1) ELSE 0 END AS key,
  CASE WHEN record_type = 'trade' THEN coalesce(lb, -1) ELSE 0 END AS buy_key, CASE WHEN record_type = 'trade' THEN coalesce(ls, -1) ELSE 0 END AS sell_key FROM oe0)"""
BOOK = f""",
es AS (SELECT *, max((arrival_ts // {HOUR} + 1) * {HOUR}) OVER (PARTITION BY channel_id ORDER BY seq_id) AS slot FROM oe),
ad AS (SELECT symbol, key, seq_id AS aseq, price, side, qty AS q, slot AS aslot FROM es WHERE kind = 'add' AND qty > 0 AND price > 0),
de AS (SELECT symbol, key, seq_id, 0 AS leg, slot, CASE WHEN qty <= 0 THEN 1152921504606846976 ELSE qty END AS d FROM es WHERE kind = 'cancel'
  UNION ALL SELECT symbol, buy_key, seq_id, 0, slot, qty FROM es WHERE kind = 'trade' AND buy_key <> 0
  UNION ALL SELECT symbol, sell_key, seq_id, 1, slot, qty FROM es WHERE kind = 'trade' AND sell_key <> 0),
dh AS (SELECT de.*, ad.q, aseq IS NOT NULL AND de.seq_id > aseq AS live, sum(CAST(d AS DOUBLE)) OVER (PARTITION BY de.symbol, de.key ORDER BY de.seq_id, leg) AS cs
  FROM de LEFT JOIN ad ON ad.symbol = de.symbol AND ad.key = de.key),
ul AS (SELECT symbol, slot, count(*) AS lost FROM dh WHERE NOT live OR q - (cs - d) <= 0 GROUP BY ALL),
ch AS (SELECT DISTINCT channel_id, slot FROM es),
hm AS (SELECT symbol, max(channel_id) AS channel_id, max(exchange) AS exchange, min(slot) AS first FROM es GROUP BY symbol),
fr AS (SELECT hm.symbol, exchange, ch.slot FROM hm JOIN ch ON ch.channel_id = hm.channel_id AND ch.slot >= first),
rm AS (SELECT fr.symbol, fr.slot, ad.side, ad.price, greatest(ad.q - coalesce((SELECT sum(CAST(d AS DOUBLE)) FROM dh WHERE dh.symbol = ad.symbol AND dh.key = ad.key AND dh.live AND dh.slot <= fr.slot), 0), 0) AS rem
  FROM fr JOIN ad ON ad.symbol = fr.symbol AND aslot <= fr.slot),
lv AS (SELECT symbol, slot, side, price, sum(rem) AS qty, count(*) AS cnt FROM rm WHERE rem > 0 GROUP BY ALL),
lr AS (SELECT *, row_number() OVER (PARTITION BY symbol, slot, side ORDER BY CASE side WHEN 'buy' THEN -price ELSE price END) AS k FROM lv),
sb AS (SELECT symbol, slot, coalesce(max(price) FILTER (WHERE side = 'buy' AND k = 1), 0) AS best_bid, coalesce(max(price) FILTER (WHERE side = 'sell' AND k = 1), 0) AS best_ask,
  coalesce(max(qty) FILTER (WHERE side = 'buy' AND k = 1), 0) AS bid_qty, coalesce(max(qty) FILTER (WHERE side = 'sell' AND k = 1), 0) AS ask_qty,
  coalesce(sum(qty) FILTER (WHERE side = 'buy' AND k <= 5), 0) AS bid_depth5, coalesce(sum(qty) FILTER (WHERE side = 'sell' AND k <= 5), 0) AS ask_depth5,
  coalesce(sum(cnt) FILTER (WHERE side = 'buy'), 0) AS n_bid_orders, coalesce(sum(cnt) FILTER (WHERE side = 'sell'), 0) AS n_ask_orders,
  count(*) FILTER (WHERE side = 'buy') AS bid_levels, count(*) FILTER (WHERE side = 'sell') AS ask_levels FROM lr GROUP BY symbol, slot),
fl AS (SELECT symbol, slot, count(*) FILTER (WHERE kind = 'trade') AS slot_trades, coalesce(sum(qty) FILTER (WHERE kind = 'trade'), 0) AS slot_qty,
  coalesce(sum(qty) FILTER (WHERE kind = 'trade' AND side = 'buy'), 0) AS slot_buy_qty, coalesce(sum(qty) FILTER (WHERE kind = 'trade' AND side = 'sell'), 0) AS slot_sell_qty FROM es GROUP BY symbol, slot),
bj AS (SELECT fr.slot, fr.symbol, fr.exchange, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('best_bid', 'best_ask'))},
  {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('bid_qty', 'ask_qty', 'bid_depth5', 'ask_depth5', 'n_bid_orders', 'n_ask_orders', 'bid_levels', 'ask_levels', 'slot_trades', 'slot_qty', 'slot_buy_qty', 'slot_sell_qty'))},
  CAST(sum(coalesce(lost, 0)) OVER (PARTITION BY fr.symbol ORDER BY fr.slot) AS BIGINT) AS unresolved
  FROM fr LEFT JOIN sb ON sb.symbol = fr.symbol AND sb.slot = fr.slot LEFT JOIN fl ON fl.symbol = fr.symbol AND fl.slot = fr.slot LEFT JOIN ul ON ul.symbol = fr.symbol AND ul.slot = fr.slot),
bk AS (SELECT *, CASE WHEN best_bid > 0 AND best_ask > 0 THEN best_ask - best_bid END AS spread, CASE WHEN best_bid > 0 AND best_ask > 0 THEN (best_bid + best_ask) / 2 END AS mid,
  CASE WHEN best_bid > 0 AND best_ask > 0 THEN CASE WHEN bid_qty + ask_qty > 0 THEN (best_bid * ask_qty + best_ask * bid_qty) / (bid_qty + ask_qty) ELSE (best_bid + best_ask) / 2 END END AS microprice,
  CASE WHEN bid_qty + ask_qty > 0 THEN (bid_qty - ask_qty) / (bid_qty + ask_qty) ELSE 0 END AS imbalance_l1,
  CASE WHEN bid_depth5 + ask_depth5 > 0 THEN (bid_depth5 - ask_depth5) / (bid_depth5 + ask_depth5) ELSE 0 END AS imbalance_l5 FROM bj WHERE n_bid_orders + n_ask_orders > 0 OR slot_trades > 0)"""


def snapshots(spark, d, width=HOUR):
    from ...functions.ordered import measure
    return measure(BK.book_snapshots(order_events(spark, d), width), "symbol", "slot")


_BK_DBL = ("best_bid", "best_ask", "spread", "mid", "microprice", "imbalance_l1", "imbalance_l5")
_BK_COLS = ", ".join([r(c, c, 7) for c in _BK_DBL] + ["slot", "symbol", "exchange", "bid_qty", "ask_qty", "bid_depth5", "ask_depth5", "n_bid_orders",
                     "n_ask_orders", "bid_levels", "ask_levels", "slot_trades", "slot_qty", "slot_buy_qty", "slot_sell_qty", "unresolved"])
_BOOK = f"WITH {TICKS} {EVENTS} {BOOK}"


@add("book_snapshots", f"{_BOOK} SELECT {_BK_COLS} FROM bk")
def book(spark, d):
    return rounded(BK.book_snapshots(order_events(spark, d), HOUR), 7)


@add("book_own_slots", f"{_BOOK} SELECT bk.slot, bk.symbol, n_bid_orders, n_ask_orders, unresolved FROM bk JOIN fl USING (symbol, slot)")
def book_own(spark, d):
    return BK.book_snapshots(order_events(spark, d), HOUR, grid="own").select("slot", "symbol", "n_bid_orders", "n_ask_orders", "unresolved")


@add("book_quality", f"""{_BOOK} SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, count(DISTINCT slot) AS n_slots,
  {r('avg(CASE WHEN best_bid > 0 AND best_ask > 0 THEN 1.0 ELSE 0.0 END)', 'two_sided_share')}, max(unresolved) AS max_unresolved FROM bk WHERE slot > {1704067200 * 10**9 + 48 * HOUR}""")
def book_quality(spark, d):
    s = BK.trim_warmup(BK.book_snapshots(order_events(spark, d), HOUR), 1704067200 * 10**9 + 48 * HOUR)
    return rounded(BK.book_quality(s))


@add("book_order_key_events", f"""WITH {TICKS} {_ROUTE}
SELECT channel_id, seq_id, arrival_ts, symbol, exchange, record_type AS kind, {r('price', 'price')}, volume AS qty, side, CASE exchange WHEN 'XSHG' THEN seq_id + 1000000 ELSE seq_id END AS key, CAST(0 AS BIGINT) AS buy_key, CAST(0 AS BIGINT) AS sell_key FROM od
UNION ALL SELECT channel_id, seq_id, arrival_ts, symbol, exchange, record_type, {r('price', 'price')}, volume, side, CASE WHEN record_type = 'cancel' THEN CASE WHEN seq_id % 3 > 0 THEN seq_id - 1 ELSE seq_id - 2 END ELSE 0 END,
  CASE WHEN record_type = 'trade' AND seq_id % 3 > 0 THEN seq_id - 1 ELSE 0 END, CASE WHEN record_type = 'trade' THEN seq_id - 2 ELSE 0 END FROM td""")
def key_events(spark, d):
    o, t = split_streams(spark, d)
    s = F.col("seq_id")
    # a cancel carries the reference of its own side only, also when that is order 0
    other = (F.col("record_type") == "cancel") & (s % 3 > 0)
    t = t.withColumns({"buy_seq_id": F.when(s % 3 > 0, s - 1).otherwise(0), "sell_seq_id": F.when(other, 0).otherwise(s - 2)})
    return rounded(BK.order_key_events(o.withColumn("order_id", s + 1000000), t))


_BF = {
    "micro_tilt": _squash(f"((_mc - _md) / {_g('_sp')})"), "imb_l1": "imbalance_l1", "imb_l5": "imbalance_l5", "rel_spread": f"_sp / {_g('_md')}",
    "order_count_imb": "(n_bid_orders - n_ask_orders) / greatest(n_bid_orders + n_ask_orders, 1e-12)",
    "bid_order_size": "bid_depth5 / greatest(n_bid_orders, 1)", "ask_order_size": "ask_depth5 / greatest(n_ask_orders, 1)",
    "book_slope": "(bid_depth5 + ask_depth5) / greatest(bid_qty + ask_qty, 1e-12)", "consumption": "ln(1 + slot_qty / greatest(bid_depth5 + ask_depth5, 1e-12))",
    "micro_mom_10": "_mc / lag(_mc, 10) OVER s - 1", "micro_rev_3": "-(_mc / lag(_mc, 3) OVER s - 1)",
    "spread_z": f"CASE WHEN {_m('stddev_samp', '_sp')} > 1e-9 THEN (_sp - {_m('avg', '_sp')}) / {_m('stddev_samp', '_sp')} WHEN {_m('stddev_samp', '_sp')} IS NOT NULL AND _sp IS NOT NULL THEN 0 END",
    "imb_persist": _m("avg", "imbalance_l1"),
}
_BFSTAGE = """,
b1 AS (SELECT *, last_value(mid IGNORE NULLS) OVER q AS _md, last_value(microprice IGNORE NULLS) OVER q AS _mc, last_value(spread IGNORE NULLS) OVER q AS _sp FROM bk
  WINDOW q AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def book_features(spark, d):
    f = FF.build_book_features(snapshots(spark, d))
    # a crossed or empty book divides by 1e-12: compared on a log scale
    t = F.col("micro_tilt")
    return f.withColumns({"consumption": F.log(1 + F.col("consumption")),
                          "micro_tilt": F.signum(t) * F.log(1 + F.abs(t))})


@add("feature_book", f"""{_BOOK} {_BFSTAGE} SELECT slot, symbol, {', '.join(r(e, n, 7) for n, e in _BF.items() if n != 'spread_z')} FROM b1 WINDOW {_FW}""")
def feature_book(spark, d):
    return rounded(book_features(spark, d).select("slot", "symbol", *[c for c in FF.BOOK_FEATURES if c != "spread_z"]), 7)


@add("feature_book_spread_z", f"""{_BOOK} {_BFSTAGE} SELECT slot, symbol, {r(_BF['spread_z'], 'spread_z', 6)} FROM b1 WINDOW {_FW}""")
def feature_spread_z(spark, d):
    return rounded(FF.build_book_features(snapshots(spark, d)).select("slot", "symbol", "spread_z"), 6)


@add("feature_book_on_flow", f"""{_BOOK} {_BFSTAGE} {_ROUTE} {SLOTS},
bf AS (SELECT slot, symbol, {_BF['imb_persist']} AS imb_persist, {_BF['rel_spread']} AS rel_spread FROM b1 WINDOW {_FW})
SELECT slt.slot, slt.symbol, n_trades, {r('imb_persist', 'imb_persist', 7)}, {r('rel_spread', 'rel_spread', 7)} FROM slt LEFT JOIN bf ON bf.slot = slt.slot AND bf.symbol = slt.symbol""")
def book_on_flow(spark, d):
    j = FF.join_book(slot_panel(spark, d), book_features(spark, d))
    return rounded(j.select("slot", "symbol", "n_trades", "imb_persist", "rel_spread"), 7)
