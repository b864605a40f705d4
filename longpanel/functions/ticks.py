"""Column expressions over raw order and trade records.

One vocabulary is used everywhere: record types ``add``, ``cancel``, ``trade``, ``status``;
sides ``buy`` and ``sell``; venues ``XSHG`` and ``XSHE``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ratio

# Implied decimals of each venue's integer fields.
PRICE_SCALE = {"XSHG": 100_000, "XSHE": 10_000}
QUANTITY_SCALE = {"XSHG": 1_000, "XSHE": 100}
AMOUNT_SCALE = {"XSHG": 100, "XSHE": 10_000}
# Vendor codes of venue and direction.
VENDOR_VENUE = {3553: "XSHG", 3554: "XSHE"}
VENDOR_SIDE = {1063: "buy", 1550: "sell"}
# Nanoseconds per tick of the vendor clock, by schema generation and stream.
TIME_UNIT_NS = {
    "index": 1_000_000, "order": 1_000_000, "transaction": 1_000_000,
    "v2_quotation": 1_000_000, "v2_order": 1_000_000, "v2_transaction": 1_000_000,
    "v3_quotation": 1, "v3_index": 1, "v3_order": 1, "v3_transaction": 1,
}


def _lookup(key: Column, table: dict) -> Column:
    items = list(table.items())
    out = F.when(key == items[0][0], F.lit(items[0][1]))
    for k, v in items[1:]:
        out = out.when(key == k, F.lit(v))
    return out


def scale(exchange: Column, table: dict) -> Column:
    """Scale factor of the record's own venue; NULL for an unknown venue."""
    return _lookup(exchange, table)


def to_price(raw: Column, exchange: Column) -> Column:
    return ratio(raw, scale(exchange, PRICE_SCALE))


def to_quantity(raw: Column, exchange: Column) -> Column:
    return ratio(raw, scale(exchange, QUANTITY_SCALE))


def to_amount(raw: Column, exchange: Column) -> Column:
    return ratio(raw, scale(exchange, AMOUNT_SCALE))


def from_vendor_price(price: Column, exchange: Column) -> Column:
    """Vendor float to the exchange's integer price; rounds half-even and never truncates."""
    return F.rint(price * scale(exchange, PRICE_SCALE)).cast("bigint")


def snap_price(price: Column, exchange: Column) -> Column:
    """Float price on the tick grid; unknown venues keep the vendor value."""
    s = scale(exchange, PRICE_SCALE)
    return F.coalesce(ratio(F.rint(price * s), s), price)


def truncates_low(price: Column, exchange: Column) -> Column:
    """Whether truncation instead of rounding would lose a tick."""
    x = price * scale(exchange, PRICE_SCALE)
    return F.floor(x) != F.rint(x)


def venue_of_symbol(symbol: Column) -> Column:
    """Venue by code range; a record's own venue always wins over this."""
    return F.when(F.substring(symbol, 1, 1).isin("5", "6", "9"), "XSHG").otherwise("XSHE")


def suffix_of(exchange: Column) -> Column:
    return F.when(exchange == "XSHG", ".SH").otherwise(".SZ")


def symbol_of(code: Column) -> Column:
    """Vendor integer code to the zero-padded symbol."""
    return F.lpad(code.cast("string"), 6, "0")


def venue_of(market: Column) -> Column:
    return _lookup(market, VENDOR_VENUE)


def side_of(code: Column) -> Column:
    return _lookup(code, VENDOR_SIDE)


def record_type_of(stream: Column, update_type: Column, trade_type: Column) -> Column:
    """Vendor codes: the order stream reads ``updateType``, the trade stream ``tradeType``."""
    order = F.when(update_type == 1, "add").when(update_type == 2, "cancel").otherwise("status")
    trade = F.when(trade_type == 1, "trade").when(trade_type == 2, "cancel").otherwise("status")
    return F.when(stream == "order", order).when(stream == "trade", trade).otherwise("status")


def record_type_of_exec(exchange: Column, stream: Column, exec_type: Column) -> Column:
    """Exchange ``ExecType``: Shanghai cancels ride the order stream, Shenzhen's the trade stream."""
    on_order = exchange == "XSHG"
    order = (F.when(exec_type == "0", "add")
             .when(on_order & (exec_type == "4"), "cancel").otherwise("status"))
    trade = (F.when(exec_type == "F", "trade")
             .when(~on_order & (exec_type == "4"), "cancel").otherwise("status"))
    return F.when(stream == "order", order).when(stream == "trade", trade).otherwise("status")


def is_directional(side_code: Column) -> Column:
    """Only ``1`` and ``2`` are buying and selling; ``G`` and ``F`` are securities lending."""
    return F.coalesce(side_code.isin("1", "2"), F.lit(False))


def _div(x: Column, n: int) -> Column:
    """Integer division in BIGINT; 17-digit stamps do not fit a double."""
    return F.call_function("div", x, F.lit(n))


def _clock(date: Column, t: Column) -> Column:
    sec = (t % 100_000).cast("decimal(16,6)") / F.lit(1000).cast("decimal(4,0)")
    return F.make_timestamp_ntz(
        _div(date, 10_000).cast("int"), (_div(date, 100) % 100).cast("int"),
        (date % 100).cast("int"), _div(t, 10_000_000).cast("int"),
        (_div(t, 100_000) % 100).cast("int"), sec.cast("decimal(16,6)"))


def decode_sse_time(trade_date: Column, hhmmssmmm: Column) -> Column:
    """``yyyyMMdd`` and ``HHmmssSSS`` integers to a timestamp."""
    return _clock(trade_date.cast("bigint"), hhmmssmmm.cast("bigint"))


def decode_szse_time(stamp: Column) -> Column:
    """``yyyyMMddHHmmssSSS`` to a timestamp."""
    s = stamp.cast("bigint")
    return _clock(_div(s, 1_000_000_000), s % 1_000_000_000)


def phase_flags(code: Column, exchange: Column) -> Column:
    """Struct of tradability flags from the phase code.

    Short or missing codes degrade to not tradable.
    """
    s = F.rpad(F.coalesce(code, F.lit("")), 4, " ")
    first = F.substring(s, 1, 1)
    phase = F.when(first.isin("S", "C", "T", "E", "P", "M", "N", "U"), first).otherwise("?")
    halted = phase.isin("P", "N")
    trading = phase.isin("T", "C", "U")
    sse = exchange == "XSHG"
    can = F.when(sse, F.substring(s, 2, 1) == "1").otherwise(~halted)
    is_listed = F.when(sse, F.substring(s, 3, 1) != "0").otherwise(True)
    accepts = F.when(sse, F.substring(s, 4, 1) == "1").otherwise(trading)
    return F.struct(
        phase.alias("phase"), can.alias("can_trade"), is_listed.alias("is_listed"),
        accepts.alias("accepts_orders"), halted.alias("is_halted"),
        phase.isin("C", "U", "M").alias("is_auction"),
        (is_listed & can & ~halted & trading).alias("is_tradable"))


def pit_timestamp(arrival: Column, exchange: Column) -> Column:
    """The stamp a feature is gated on: arrival, or exchange time when none was captured."""
    return F.coalesce(arrival, exchange)


def wire_latency(arrival: Column, exchange: Column) -> Column:
    return arrival - exchange


def is_causal(exchange: Column, broker: Column, arrival: Column) -> Column:
    """``exchange <= broker <= arrival``; a record without arrival cannot be refuted."""
    leg = broker.isNull() | ((exchange <= broker) & (broker <= arrival))
    return arrival.isNull() | F.coalesce((arrival >= exchange) & leg, F.lit(False))


def right_label(ts_ns: Column, width_ns: int) -> Column:
    """Closing edge of the slot of a stamp; a record on a boundary opens the next slot."""
    return ts_ns - F.pmod(ts_ns, F.lit(width_ns)) + F.lit(width_ns)
