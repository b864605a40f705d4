"""Order-book state from order and trade records, as set operations.

Every resting order is an add minus the decrements that name it.  Decrements are accumulated
per order, the resulting changes per price level, and level lifetimes are laid over the slots
to snapshot.  Nothing replays events one at a time, and no step gathers a symbol.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import SYMBOL, ratio, require_columns
from ..functions.ordered import BROADCAST_VALUES, annotate, durable, row_bound, with_running
from ..functions.ticks import right_label

CHANNEL, SEQ = "channel_id", "seq_id"
EVENT_COLUMNS = (CHANNEL, SEQ, "arrival_ts", SYMBOL, "exchange", "kind", "price", "qty", "side",
                 "key", "buy_key", "sell_key")
# More than any order can hold: a cancel without quantity removes what is left.
ALL_OF_IT = 1 << 60


def order_key_events(orders: DataFrame, trades: DataFrame) -> DataFrame:
    """One event table keyed by resting order.

    Shanghai orders are identified by ``order_id``, Shenzhen's by ``seq_id``; a Shenzhen cancel
    arrives on the trade stream and names the order through its buy or sell reference.
    """
    sse = F.col("exchange") == "XSHG"
    zero = F.lit(0).cast("bigint")
    o = orders.where(F.col("record_type").isin("add", "cancel")).select(
        CHANNEL, SEQ, "arrival_ts", SYMBOL, "exchange", F.col("record_type").alias("kind"),
        "price", F.col("volume").alias("qty"), "side",
        F.when(sse, F.col("order_id")).otherwise(F.col(SEQ)).cast("bigint").alias("key"),
        zero.alias("buy_key"), zero.alias("sell_key"))
    buy, sell = F.coalesce("buy_seq_id", zero), F.coalesce("sell_seq_id", zero)
    cancel = F.col("record_type") == "cancel"
    t = trades.where(F.col("record_type").isin("trade", "cancel")).select(
        CHANNEL, SEQ, "arrival_ts", SYMBOL, "exchange", F.col("record_type").alias("kind"),
        "price", F.col("volume").alias("qty"), "side",
        F.when(cancel, F.when(buy != 0, buy).otherwise(sell)).otherwise(zero).alias("key"),
        F.when(cancel, zero).otherwise(buy).alias("buy_key"),
        F.when(cancel, zero).otherwise(sell).alias("sell_key"))
    return o.unionByName(t)


def slot_events(events: DataFrame, slot_ns: int, session: Sequence[str] = ()) -> DataFrame:
    """Events with ``slot``: the running maximum over sequence order, so a late arrival cannot
    reopen a closed slot."""
    e = events.withColumn("_label", right_label(F.col("arrival_ts"), slot_ns))
    return with_running(e, [*session, CHANNEL], [SEQ], {"slot": ("max", F.col("_label"))}
                        ).drop("_label")


def _decrements(events: DataFrame, by: list[str]) -> DataFrame:
    """Cancels and trade legs as ``(by, key, seq, leg, slot, d)``."""
    legs = F.when(F.col("kind") == "cancel", F.array(F.struct(
        F.lit(0).alias("leg"), F.col("key").alias("key"),
        F.when(F.col("qty") <= 0, F.lit(ALL_OF_IT)).otherwise(F.col("qty")).alias("d")))
    ).when(F.col("kind") == "trade", F.array(
        F.struct(F.lit(0).alias("leg"), F.col("buy_key").alias("key"), F.col("qty").alias("d")),
        F.struct(F.lit(1).alias("leg"), F.col("sell_key").alias("key"), F.col("qty").alias("d"))))
    # a cancel names an order whatever its key; a zero reference of a trade names none
    return events.where(F.col("kind").isin("cancel", "trade")).select(
        *by, CHANNEL, SEQ, "slot", "kind", F.explode(legs).alias("_l")).select(
        *by, CHANNEL, SEQ, "slot", "kind", "_l.leg", "_l.key", "_l.d").where(
        (F.col("kind") == "cancel") | (F.col("key") != 0)).drop("kind")


def _adds(events: DataFrame, by: list[str]) -> DataFrame:
    """Adds with ``_until`` and ``_uslot``: where the same key is added again, which ends this order."""
    ok = ((F.col("kind") == "add") & (F.col("qty") > 0) & (F.col("price") > 0)
          & F.col("side").isin("buy", "sell"))
    adds = events.where(ok).select(*by, "key", F.col(SEQ).alias("_aseq"), "price", "side",
                                   F.col("qty").alias("_q"), F.col("slot").alias("_aslot"))
    # a key names few orders
    again = W.partitionBy(*by, "key").orderBy("_aseq")
    return adds.withColumns({"_until": F.lead("_aseq").over(again), "_uslot": F.lead("_aslot").over(again)})


def order_changes(slotted: DataFrame, session: Sequence[str] = ()
                  ) -> tuple[DataFrame, DataFrame]:
    """``(changes, unresolved)``: signed quantity and order-count changes per event, and the
    decrements that found no resting order.

    A key that is added again names the new order from there on; what is left of the old one goes.
    """
    by = [*session, SYMBOL]
    adds, dec = _adds(slotted, by), _decrements(slotted, by)
    named = adds.withColumnsRenamed({k: f"_of_{k}" for k in [*by, "key"]})
    same = [F.col(k) == F.col(f"_of_{k}") for k in [*by, "key"]]
    alive = (F.col(SEQ) > F.col("_aseq")) & (F.col("_until").isNull() | (F.col(SEQ) < F.col("_until")))
    # at most one order of a key is alive at a time, so a decrement stays one row
    # read by four branches below
    hit = durable(dec.join(named, [*same, alive], "left").drop(*[f"_of_{k}" for k in [*by, "key"]]))
    missed = hit.where(F.col("_aseq").isNull()).select(*by, "slot")
    hit = hit.where(F.col("_aseq").isNotNull())
    ended = adds.where(F.col("_until").isNotNull()).withColumns({
        SEQ: F.col("_until"), "slot": F.col("_uslot"), "leg": F.lit(-1), "d": F.lit(ALL_OF_IT)})
    hit = hit.drop(CHANNEL).withColumn("_own", F.lit(False)).unionByName(
        ended.select(*[c for c in hit.columns if c != CHANNEL], F.lit(True).alias("_own")))
    order = [*by, "key", "_aseq"]
    hit = annotate(hit, {"key": (row_bound(hit.select(*order), order), 0)})
    # (seq, leg) numbers the decrements of an order
    hit = with_running(hit, order, [SEQ, "leg"], {"_cs": ("sum", F.col("d").cast("double"))})
    q = F.col("_q").cast("double")
    after, before = F.greatest(q - F.col("_cs"), F.lit(0.0)), q - (F.col("_cs") - F.col("d"))
    hit = hit.withColumns({"_after": after, "_before": before})
    used = hit.where(F.col("_before") > 0)
    spent = hit.where((F.col("_before") <= 0) & ~F.col("_own")).select(*by, "slot")
    changes = adds.select(*by, "side", "price", F.col("_aslot").alias("slot"),
                          F.col("_q").cast("bigint").alias("dq"), F.lit(1).alias("dn")).unionByName(
        used.select(*by, "side", "price", "slot",
                    (F.col("_after") - F.col("_before")).cast("bigint").alias("dq"),
                    F.when(F.col("_after") <= 0, -1).otherwise(0).alias("dn")))
    return changes, missed.unionByName(spent)


def book_snapshots(events: DataFrame, slot_ns: int, *, session: Sequence[str] = (),
                   levels: int = 5, grid: str = "channel") -> DataFrame:
    """One row per (slot, symbol): book at the closing edge and the flow inside the slot.

    ``grid="channel"`` snapshots a symbol at every slot of its channel from its first record on;
    ``grid="own"`` only at slots in which the symbol itself has a record.  Slots with an empty
    book and no trade are left out.  ``session`` names columns (a trade date) at which books
    start empty.  A symbol with records on two channels in one session is an error.
    """
    require_columns(events, EVENT_COLUMNS, "book_snapshots")
    if grid not in ("channel", "own"):
        raise ValueError(f"grid must be 'channel' or 'own', got {grid!r}")
    ses = list(session)
    by = [*ses, SYMBOL]
    # read by seven branches below, each with other columns: stored once instead of reshuffled
    e = durable(slot_events(events, slot_ns, ses))

    # slots are numbered within a channel; a channel has few slots, whatever its record count
    slots = e.select(*ses, CHANNEL, "slot").distinct()
    cw = W.partitionBy(*ses, CHANNEL)
    slots = slots.withColumns({
        "_k": (F.row_number().over(cw.orderBy("slot")) - 1).cast("int"),
        "_n": F.count(F.lit(1)).over(cw).cast("int")})
    # slots are those of one channel: a symbol on two would lose the records of the other
    one = F.when(F.min(CHANNEL).eqNullSafe(F.max(CHANNEL)), F.max(CHANNEL)).otherwise(F.raise_error(
        F.concat(F.lit("records of one symbol on two channels: "), F.first(SYMBOL).cast("string"))).cast(e.schema[CHANNEL].dataType))
    homes = e.groupBy(*by).agg(one.alias(CHANNEL), F.max("exchange").alias("exchange"),
                               F.min("slot").alias("_first"))
    homes = homes.join(slots.select(*ses, CHANNEL, F.col("slot").alias("_first"),
                                    F.col("_k").alias("_k0"), "_n"), [*ses, CHANNEL, "_first"])
    at = slots.select(*ses, CHANNEL, "slot", "_k")
    if at.count() <= BROADCAST_VALUES:
        at = F.broadcast(at)

    # sums of integer changes per level and slot, combined before the shuffle
    changes, lost = order_changes(e, ses)
    lv = durable(changes.groupBy(*by, "side", "price", "slot").agg(
        F.sum("dq").alias("dq"), F.sum("dn").alias("dn")))
    # a book can only differ at slots in which it changed: levels are laid over those, and the
    # finished state is carried to the slots in between.  One row per symbol and slot.
    marks = lv.select(*by, "slot").distinct().join(homes.select(*by, CHANNEL, "_n"), by).join(
        at, [*ses, CHANNEL, "slot"])
    mw = W.partitionBy(*by).orderBy("_k")
    marks = marks.select(
        *by, CHANNEL, "slot", "_k", (F.row_number().over(mw) - 1).alias("_j"),
        F.count(F.lit(1)).over(W.partitionBy(*by)).cast("int").alias("_m"),
        F.coalesce(F.lead("_k").over(mw), F.col("_n")).alias("_next"))
    lv = lv.join(marks.select(*by, "slot", "_j", "_m"), [*by, "slot"])
    # a level has at most one row per slot
    w = W.partitionBy(*by, "side", "price").orderBy("_j")
    lv = lv.withColumns({
        "_qty": F.sum("dq").over(w), "_cnt": F.sum("dn").over(w),
        "_end": F.coalesce(F.lead("_j").over(w), F.col("_m"))})
    lv = lv.where(F.col("_qty") > 0).select(
        *by, "side", "price", "_qty", "_cnt",
        F.explode(F.sequence(F.col("_j"), F.col("_end") - 1)).alias("_j"))
    best = F.when(F.col("side") == "buy", -F.col("price")).otherwise(F.col("price"))
    depth = W.partitionBy(*by, "_j", "side").orderBy(best)
    lv = lv.withColumn("_rk", F.row_number().over(depth))
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"

    def top(side: Column, col: str) -> Column:
        return F.max(F.when(side & (F.col("_rk") == 1), F.col(col)))

    def total(side: Column, col: str) -> Column:
        return F.coalesce(F.sum(F.when(side, F.col(col))), F.lit(0)).cast("bigint")

    near = F.col("_rk") <= levels
    state = lv.groupBy(*by, "_j").agg(
        F.coalesce(top(buy, "price"), F.lit(0.0)).alias("best_bid"),
        F.coalesce(top(sell, "price"), F.lit(0.0)).alias("best_ask"),
        F.coalesce(top(buy, "_qty"), F.lit(0)).alias("bid_qty"),
        F.coalesce(top(sell, "_qty"), F.lit(0)).alias("ask_qty"),
        total(buy & near, "_qty").alias("bid_depth5"), total(sell & near, "_qty").alias("ask_depth5"),
        total(buy, "_cnt").alias("n_bid_orders"), total(sell, "_cnt").alias("n_ask_orders"),
        F.count(F.when(buy, 1)).alias("bid_levels"), F.count(F.when(sell, 1)).alias("ask_levels"))

    state = state.join(marks.select(*by, CHANNEL, "_j", "_k", "_next"), [*by, "_j"])
    state = state.withColumn("_k", F.explode(F.sequence(F.col("_k"), F.col("_next") - 1))).join(
        at, [*ses, CHANNEL, "_k"]).drop("_j", "_next", CHANNEL, "_k")

    trade = F.col("kind") == "trade"

    def flow_sum(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("qty"))), F.lit(0)).cast("bigint")

    flow = e.groupBy(*by, "slot").agg(
        F.count(F.when(trade, 1)).alias("slot_trades"), flow_sum(trade).alias("slot_qty"),
        flow_sum(trade & buy).alias("slot_buy_qty"), flow_sum(trade & sell).alias("slot_sell_qty"),
        F.lit(True).alias("_own"))
    miss = lost.groupBy(*by, "slot").agg(F.count(F.lit(1)).alias("_lost"))

    frame = homes.select(*by, CHANNEL, "exchange", F.explode(
        F.sequence(F.col("_k0"), F.col("_n") - 1)).alias("_k")).join(at, [*ses, CHANNEL, "_k"]).select(
        *by, "slot", "exchange", F.lit(True).alias("_framed"))
    # each part has at most one row per symbol and slot: they go to their symbol once, where joins would move the whole
    # frame for each, and the windows over a symbol's slots need no Exchange after that
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (frame, state, flow, miss)).repartition(*by)
    out = parts.groupBy(*by, "slot").agg(
        *[F.max(c).alias(c) for c in parts.columns if c not in (*by, "slot")]).where("_framed").drop("_framed")
    counts = ("bid_qty", "ask_qty", "bid_depth5", "ask_depth5", "n_bid_orders", "n_ask_orders",
              "bid_levels", "ask_levels", "slot_trades", "slot_qty", "slot_buy_qty",
              "slot_sell_qty", "_lost")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counts})
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("best_bid", "best_ask")})
    # one row per symbol and slot
    out = out.withColumn("unresolved", F.sum("_lost").over(
        W.partitionBy(*by).orderBy("slot").rowsBetween(W.unboundedPreceding, 0)))
    keep = (F.col("n_bid_orders") + F.col("n_ask_orders") > 0) | (F.col("slot_trades") > 0)
    if grid == "own":
        keep = keep & F.coalesce(F.col("_own"), F.lit(False))
    return quote_columns(out.where(keep)).select(
        *ses, "slot", SYMBOL, "exchange", "best_bid", "best_ask", "spread", "mid", "microprice",
        "bid_qty", "ask_qty", "bid_depth5", "ask_depth5", "imbalance_l1", "imbalance_l5",
        "n_bid_orders", "n_ask_orders", "bid_levels", "ask_levels", "slot_trades", "slot_qty",
        "slot_buy_qty", "slot_sell_qty", "unresolved")


def quote_columns(df: DataFrame) -> DataFrame:
    """Spread, mid, microprice and imbalances; NULL quotes where a side is empty."""
    bid, ask = F.col("best_bid"), F.col("best_ask")
    two = (bid > 0) & (ask > 0)
    mid = (bid + ask) / 2
    q = F.col("bid_qty") + F.col("ask_qty")
    d5 = F.col("bid_depth5") + F.col("ask_depth5")
    micro = F.when(q > 0, ratio(bid * F.col("ask_qty") + ask * F.col("bid_qty"), q)).otherwise(mid)
    return df.withColumns({
        "spread": F.when(two, ask - bid), "mid": F.when(two, mid),
        "microprice": F.when(two, micro),
        "imbalance_l1": F.when(q > 0, ratio(F.col("bid_qty") - F.col("ask_qty"), q)).otherwise(0.0),
        "imbalance_l5": F.when(d5 > 0, ratio(F.col("bid_depth5") - F.col("ask_depth5"), d5))
        .otherwise(0.0)})


def trim_warmup(snapshots: DataFrame, warm_until: int) -> DataFrame:
    """Drop slots that only warm the book; needed only when the input starts mid-session."""
    return snapshots.where(F.col("slot") > warm_until)


def book_quality(snapshots: DataFrame) -> DataFrame:
    """One row: size of the panel, two-sided share and the largest unresolved count."""
    two = ((F.col("best_bid") > 0) & (F.col("best_ask") > 0)).cast("double")
    return snapshots.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(SYMBOL).alias("n_symbols"),
        F.count_distinct("slot").alias("n_slots"), F.avg(two).alias("two_sided_share"),
        F.max("unresolved").alias("max_unresolved"))
