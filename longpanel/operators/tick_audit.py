"""Normalisation and audit jobs over raw order and trade tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ticks as K
from ..functions.columns import ratio, require_columns
from ..functions.ordered import group_quantiles

CHANNEL, SEQ = "channel_id", "seq_id"
# Sequence numbers handled by one task when gaps are searched.
SEQ_BLOCK = 1_000_000


def normalise_records(raw: DataFrame, stream: str, generation: str) -> DataFrame:
    """Decoded vendor records to the raw standard (nanosecond stamps, integer prices).

    Rows of an unknown venue are kept with a NULL exchange.
    """
    unit = K.TIME_UNIT_NS.get(generation)
    if unit is None:
        raise ValueError(f"no timestamp unit declared for {generation!r}")
    zero = F.lit(0)
    venue = K.venue_of(F.col("market_id"))
    cols = [
        (F.coalesce(F.col("time"), zero).cast("bigint") * unit).alias("exchange_ts"),
        (F.coalesce(F.col("spider_ts"), zero).cast("bigint") * unit).alias("arrival_ts"),
        (F.coalesce(F.col("server_ts"), zero).cast("bigint") * unit).alias("broker_ts"),
        K.symbol_of(F.coalesce(F.col("symbol_id"), zero)).alias("symbol"),
        venue.alias("exchange"),
    ]
    if stream == "index":
        return raw.select(*cols, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                   for c in ("last", "open", "high", "low", "prev_close",
                                             "total_amount")],
                          F.coalesce(F.col("total_volume"), zero).cast("bigint")
                          .alias("total_volume_lots"))
    px = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    none = F.lit(None).cast("int")
    cols += [
        K.record_type_of(F.lit(stream), F.col("update_type") if stream == "order" else none,
                         F.col("trade_type") if stream == "trade" else none).alias("record_type"),
        px.alias("price_raw"), K.from_vendor_price(px, venue).alias("price"),
        F.coalesce(F.col("volume"), zero).cast("bigint").alias("volume"),
        K.side_of(F.col("dir")).alias("side"),
        F.coalesce(F.col(CHANNEL), zero).cast("bigint").alias(CHANNEL),
        F.coalesce(F.col(SEQ), zero).cast("bigint").alias(SEQ),
    ]
    extra = ("order_id", "order_type") if stream == "order" else ("buy_seq_id", "sell_seq_id")
    return raw.select(*cols, *[F.coalesce(F.col(c), zero).cast("bigint").alias(c) for c in extra])


def replay_order(df: DataFrame) -> DataFrame:
    """Sort each partition into replay order ``(channel, seq)``; time is never an order key."""
    return df.sortWithinPartitions(CHANNEL, SEQ)


def sequence_gaps(streams: DataFrame | Sequence[DataFrame], *, start: int = 1) -> DataFrame:
    """``(channel_id, first_missing, last_missing)`` inclusive, over the merged streams.

    A channel may hold a large share of all records, so numbers are searched in blocks: gaps
    inside a block, then gaps between the ends of neighbouring blocks of a channel.
    """
    parts = [streams] if isinstance(streams, DataFrame) else list(streams)
    s = parts[0].select(CHANNEL, SEQ)
    for p in parts[1:]:
        s = s.unionByName(p.select(CHANNEL, SEQ))
    s = s.where(F.col(SEQ).isNotNull()).distinct().withColumn(
        "_b", F.floor(F.col(SEQ) / SEQ_BLOCK))
    inner = W.partitionBy(CHANNEL, "_b").orderBy(SEQ)
    inside = s.withColumn("_prev", F.lag(SEQ).over(inner)).where(F.col("_prev").isNotNull())
    ends = s.groupBy(CHANNEL, "_b").agg(F.min(SEQ).alias("_lo"), F.max(SEQ).alias("_hi"))
    # one row per channel and block: a million times smaller than the stream
    across = ends.select(
        CHANNEL, F.col("_lo").alias(SEQ),
        F.coalesce(F.lag("_hi").over(W.partitionBy(CHANNEL).orderBy("_b")),
                   F.lit(start - 1).cast("bigint")).alias("_prev"))
    return inside.select(CHANNEL, SEQ, "_prev").unionByName(across).where(
        F.col(SEQ) > F.col("_prev") + 1).select(
        CHANNEL, (F.col("_prev") + 1).alias("first_missing"),
        (F.col(SEQ) - 1).alias("last_missing"))


def hole_counts(orders: DataFrame, trades: DataFrame, *, ts: str = "exchange_ts") -> DataFrame:
    """Missing numbers per channel of each stream and of both, in their common time window."""
    o = orders.select(CHANNEL, SEQ, F.col(ts).alias("_t"), F.lit("o").alias("_s"))
    t = trades.select(CHANNEL, SEQ, F.col(ts).alias("_t"), F.lit("t").alias("_s"))
    both = o.unionByName(t).where(F.col("_t") != 0)
    span = both.groupBy("_s").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")).agg(
        F.max("lo").alias("_lo"), F.min("hi").alias("_hi")).first()
    # a record without a number is no hole's end, but the window is the streams', which it belongs to
    both = both.where((F.col(SEQ) != 0) & F.col("_t").between(span["_lo"], span["_hi"]))
    # distinct numbers first: partial aggregation drops repeats before the shuffle
    d = both.groupBy(CHANNEL, SEQ).agg(
        F.max((F.col("_s") == "o").cast("int")).alias("_o"),
        F.max((F.col("_s") == "t").cast("int")).alias("_t"))

    def one(flag, name):
        s = F.when(flag, F.col(SEQ))
        n = F.count(s)
        return [n.alias(f"{name}_n"), F.coalesce(F.max(s) - F.min(s) + 1 - n, F.lit(0))
                .alias(f"{name}_gaps")]

    return d.groupBy(CHANNEL).agg(*one(F.col("_o") == 1, "order"), *one(F.col("_t") == 1, "trade"),
                                  *one(F.lit(True), "merged"))


def latency_profile(df: DataFrame, legs: Mapping[str, tuple[str, str]], *,
                    by: str = "record_type") -> DataFrame:
    """``(by, leg, n, median, p90, p99, max, mean)`` of stamp differences.

    A percentile is the value at index ``min(n-1, int(n*p))`` of the sorted differences.  Values
    are counted first, so the sort runs over distinct latencies.
    """
    long = df.select(by, F.explode(F.array(*[
        F.struct(F.lit(k).alias("leg"), (F.col(b) - F.col(a)).alias("v"))
        for k, (a, b) in legs.items()])).alias("_l")).select(by, "_l.leg", "_l.v").where(
        F.col("v").isNotNull())
    counts = long.groupBy(by, "leg", "v").agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy(by, "leg").agg(
        F.sum("c").alias("n"), F.max("v").alias("max"),
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    hist = _below(counts, [by, "leg"], "v", "c").join(total, [by, "leg"])

    def at(p: float):
        k = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))
        hit = (F.col("below") <= k) & (k < F.col("below") + F.col("c"))
        return F.max(F.when(hit, F.col("v")))

    return hist.groupBy(by, "leg").agg(
        F.max("n").alias("n"), at(0.5).alias("median"), at(0.9).alias("p90"),
        at(0.99).alias("p99"), F.max("max").alias("max"), F.max("mean").alias("mean"))


def _below(counts: DataFrame, by: list[str], value: str, c: str, width: int = 1_000_000) -> DataFrame:
    """Rows before each distinct integer value, in two levels so no group is sorted whole.

    With nanosecond values a block is one millisecond, at most a million distinct values.
    """
    d = counts.withColumn("_b", F.floor(F.col(value) / width))
    blocks = d.groupBy(*by, "_b").agg(F.sum(c).alias("_s"))
    w = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_o", F.coalesce(F.sum("_s").over(w), F.lit(0))).drop("_s")
    inner = W.partitionBy(*by, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return d.join(blocks, [*by, "_b"]).withColumn(
        "below", F.col("_o") + F.coalesce(F.sum(c).over(inner), F.lit(0))).drop("_b", "_o")


def causality_share(df: DataFrame, *, by: str = "record_type") -> DataFrame:
    """Share of complete stamp triples with ``broker <= arrival``, and of causal records."""
    full = (F.col("exchange_ts") != 0) & (F.col("broker_ts") != 0) & (F.col("arrival_ts") != 0)
    ok = K.is_causal(F.col("exchange_ts"), F.col("broker_ts"), F.col("arrival_ts"))
    return df.where(full).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("broker_ts") <= F.col("arrival_ts")).cast("double")).alias("broker_first"),
        F.avg(ok.cast("double")).alias("causal"))


def feed_profile(df: DataFrame, *, by: Sequence[str] = ("stream",), lo_ns: int = 1420070400 * 10**9,
                 hi_ns: int = 2051222400 * 10**9) -> DataFrame:
    """Counts and ratios of a feed per stream: venues, record kinds, cancels by venue, prices
    that truncation would lose, causality breaches, stamp range and unit plausibility."""
    require_columns(df, (*by, "exchange", "record_type", "price", "exchange_ts", "arrival_ts"),
                    "feed_profile")

    def n(cond):
        return F.count(F.when(cond, 1))

    ex, kind = F.col("exchange"), F.col("record_type")
    priced = (F.col("price") > 0) & ex.isNotNull()
    stamped = (F.col("exchange_ts") > 0) & (F.col("arrival_ts") > 0)
    cancel = kind == "cancel"
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_records"),
        n(ex == "XSHG").alias("n_xshg"), n(ex == "XSHE").alias("n_xshe"),
        n(ex.isNull()).alias("n_other_venue"),
        n(kind == "add").alias("n_add"), n(cancel).alias("n_cancel"),
        n(kind == "trade").alias("n_trade"), n(kind == "status").alias("n_status"),
        n(cancel & (ex == "XSHG")).alias("n_cancel_xshg"),
        n(cancel & (ex == "XSHE")).alias("n_cancel_xshe"),
        n(priced).alias("n_priced"),
        n(priced & K.truncates_low(F.col("price"), ex)).alias("n_lossy"),
        n(stamped).alias("n_stamped"),
        n(stamped & (F.col("arrival_ts") < F.col("exchange_ts"))).alias("n_skewed"),
        F.min(F.when(F.col("exchange_ts") > 0, F.col("exchange_ts"))).alias("first_ns"),
        F.max(F.when(F.col("exchange_ts") > 0, F.col("exchange_ts"))).alias("last_ns"),
    ).withColumns({
        "lossy_share": ratio(F.col("n_lossy"), F.col("n_priced")),
        "unit_plausible": F.coalesce(F.col("first_ns").between(lo_ns, hi_ns), F.lit(False))})


def linkage_hit_rates(orders: DataFrame, trades: DataFrame, candidates: Sequence[str], *,
                      threshold: float = 0.8) -> DataFrame:
    """``(exchange, candidate, n_trades, buy_rate, sell_rate, is_key)``.

    For every candidate id column of the orders: the share of trades whose buy and sell
    references exist among the ids of their venue.
    """
    ids = orders.select("exchange", F.explode(F.array(*[
        F.struct(F.lit(c).alias("candidate"), F.col(c).cast("bigint").alias("id"))
        for c in candidates])).alias("_k")).select("exchange", "_k.candidate", "_k.id").distinct()
    # references are counted before the join, so a popular reference is one row
    refs = trades.select("exchange", F.explode(F.array(
        F.struct(F.lit("buy").alias("leg"), F.col("buy_seq_id").alias("id")),
        F.struct(F.lit("sell").alias("leg"), F.col("sell_seq_id").alias("id")))).alias("_r"),
        ((F.col("buy_seq_id") == 0) & (F.col("sell_seq_id") == 0)).alias("_zero"),
    ).where(~F.col("_zero")).groupBy("exchange", F.col("_r.leg").alias("leg"),
                                     F.col("_r.id").alias("id")).agg(
        F.count(F.lit(1)).alias("c"))
    hits = refs.join(ids, ["exchange", "id"]).groupBy("exchange", "candidate").agg(
        F.sum(F.when(F.col("leg") == "buy", F.col("c")).otherwise(0)).alias("b"),
        F.sum(F.when(F.col("leg") == "sell", F.col("c")).otherwise(0)).alias("s"))
    n = trades.groupBy("exchange").agg(F.count(F.lit(1)).alias("n_trades"))
    names = n.select("exchange", "n_trades", F.explode(F.array(
        *[F.lit(c) for c in candidates])).alias("candidate"))
    buy = F.coalesce(ratio(F.col("b"), F.col("n_trades")), F.lit(0.0))
    sell = F.coalesce(ratio(F.col("s"), F.col("n_trades")), F.lit(0.0))
    return names.join(hits, ["exchange", "candidate"], "left").select(
        "exchange", "candidate", "n_trades", buy.alias("buy_rate"), sell.alias("sell_rate"),
        (F.least(buy, sell) > threshold).alias("is_key"))


def cancel_overlap(orders: DataFrame, key: str = SEQ) -> DataFrame:
    """Per venue: distinct cancelled ids and how many of them are also ids of adds."""
    d = orders.where(F.col("record_type").isin("add", "cancel")).groupBy("exchange", key).agg(
        F.max((F.col("record_type") == "add").cast("int")).alias("_a"),
        F.max((F.col("record_type") == "cancel").cast("int")).alias("_c"))
    return d.groupBy("exchange").agg(
        F.sum("_c").alias("n_cancel_ids"), F.sum(F.col("_a") * F.col("_c")).alias("n_shared"))
