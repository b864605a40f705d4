"""Raw ticks to a right-labelled slot panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SYMBOL, at_least, ratio, require_columns
from ..functions.ticks import right_label

EPS = 1e-12
TRADE_COUNTS = ("n_trades", "volume", "amount", "buy_vol", "sell_vol", "n_buy", "n_sell",
                "max_trade")
ORDER_COUNTS = ("n_add", "n_cancel", "add_vol", "cancel_vol", "buy_add_vol", "sell_add_vol",
                "buy_cancel_vol", "sell_cancel_vol", "n_market_order")
PRICES = ("vwap", "close", "high", "low")
SLOT_AGGREGATES = ("n_trades", "volume", "amount", *PRICES, *TRADE_COUNTS[3:], *ORDER_COUNTS)


def route_cancels(orders: DataFrame, trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cancels that ride the trade stream join the order stream with order type 0."""
    moved = trades.where(F.col("record_type") == "cancel")
    cols = [c for c in orders.columns if c != "order_type"]
    have = [F.col(c) if c in trades.columns else
            F.lit(None).cast(orders.schema[c].dataType).alias(c) for c in cols]
    moved = moved.select(*have, F.lit(0).cast(orders.schema["order_type"].dataType)
                         .alias("order_type"))
    return orders.unionByName(moved), trades.where(F.col("record_type") == "trade")


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _v(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("volume"))), F.lit(0))


def trade_aggregates(trades: DataFrame, slot: Column) -> DataFrame:
    """Per (slot, symbol): counts, volumes by aggressor side, prices.  The close is the last
    record in replay order."""
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    t = trades.where(F.col("record_type") == "trade").withColumn("slot", slot)
    out = t.groupBy("slot", SYMBOL).agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum("volume").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("amount"),
        F.max_by("price", F.struct("channel_id", "seq_id")).alias("close"),
        F.max("price").alias("high"), F.min("price").alias("low"),
        F.max("volume").alias("max_trade"), _v(buy).alias("buy_vol"), _v(sell).alias("sell_vol"),
        _n(buy).alias("n_buy"), _n(sell).alias("n_sell"))
    return out.withColumn("vwap", ratio(F.col("amount"), at_least(F.col("volume"), EPS)))


def order_aggregates(orders: DataFrame, slot: Column) -> DataFrame:
    """Per (slot, symbol): adds and cancels by side, market orders (order type 1)."""
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    add, cxl = F.col("record_type") == "add", F.col("record_type") == "cancel"
    o = orders.withColumn("slot", slot)
    return o.groupBy("slot", SYMBOL).agg(
        _n(add).alias("n_add"), _n(cxl).alias("n_cancel"), _v(add).alias("add_vol"),
        _v(cxl).alias("cancel_vol"), _v(add & buy).alias("buy_add_vol"),
        _v(add & sell).alias("sell_add_vol"), _v(cxl & buy).alias("buy_cancel_vol"),
        _v(cxl & sell).alias("sell_cancel_vol"),
        _n(add & (F.col("order_type") == 1)).alias("n_market_order"))


def aggregate_to_slots(orders: DataFrame, trades: DataFrame, *, slot_ns: int = 3_000_000_000,
                       ts_col: str = "arrival_ts") -> DataFrame:
    """Slot panel ``(slot, symbol, <aggregates>)``, labelled by the closing edge on arrival time.

    Every aggregate combines map-side, so a busy symbol is never gathered.  Counts and volumes
    of a missing side are zero; prices stay NULL.
    """
    require_columns(trades, (ts_col, SYMBOL, "price", "volume", "side", "record_type",
                             "channel_id", "seq_id"), "aggregate_to_slots")
    require_columns(orders, (ts_col, SYMBOL, "volume", "side", "record_type", "order_type"),
                    "aggregate_to_slots")
    slot = right_label(F.col(ts_col), slot_ns)
    t, o = trade_aggregates(trades, slot), order_aggregates(orders, slot)
    j = t.join(o, ["slot", SYMBOL], "full")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in (*TRADE_COUNTS, *ORDER_COUNTS)}
    return j.withColumns(zero).select("slot", SYMBOL, *SLOT_AGGREGATES)
