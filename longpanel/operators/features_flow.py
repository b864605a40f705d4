"""Microstructure features over slot panels; all trailing per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SYMBOL, at_least, ratio, require_columns
from ..functions.ordered import Trail, with_running, with_trailing
from .slots import EPS, SLOT_AGGREGATES

FLOW_FEATURES = (
    "tfi", "ofi", "signed_vol_20", "cancel_ratio", "cancel_skew", "trade_intensity", "rv_20",
    "roll_spread", "kyle_lambda", "amihud", "vpin", "mom_20", "rev_3", "avg_trade_size",
    "large_trade_share", "order_size_imb", "market_order_ratio", "trade_to_order")
BOOK_FEATURES = (
    "micro_tilt", "imb_l1", "imb_l5", "rel_spread", "order_count_imb", "bid_order_size",
    "ask_order_size", "book_slope", "consumption", "micro_mom_10", "micro_rev_3", "spread_z",
    "imb_persist")

c = F.col


def _per(a: Column, b: Column, low: float = EPS) -> Column:
    """Ratio with the divisor clipped from below."""
    return ratio(a, at_least(b, low))


def build_flow_features(panel: DataFrame, *, window: int = 20) -> DataFrame:
    """Slot panel plus ``px, ret, signed_vol, tot_vol`` and the flow features.

    Prices carry over empty slots of a symbol; volumes do not.
    """
    require_columns(panel, ("slot", SYMBOL, *SLOT_AGGREGATES), "build_flow_features")
    df = with_running(panel, [SYMBOL], ["slot"], {"px": ("last", c("close"))})
    half = window // 2

    def build(d: DataFrame, t: Trail) -> DataFrame:
        d = d.withColumns({
            "ret": ratio(c("px"), t.lag(c("px"))) - 1,
            "signed_vol": c("buy_vol") - c("sell_vol"),
            "tot_vol": c("buy_vol") + c("sell_vol")})
        d = d.withColumn("_lagret", t.lag(c("ret")))
        r, s, v = c("ret"), c("signed_vol"), c("tot_vol")

        def m(x):
            return t.mean(x, window, half)

        def total(x):
            return t.sum(x, window, half)

        # staged: a clipped divisor mentions its argument twice, a window should run once
        staged = {
            "_s": total(s), "_abs_s": total(F.abs(s)), "_v": total(v), "_nt": m(c("n_trades")),
            "_rs": m(r * s), "_mr": m(r), "_ms": m(s), "_var": t.var(s, window, half),
            "_abs_r": m(F.abs(r)), "_amt": m(c("amount")), "_bounce": -m(r * c("_lagret"))}
        d = d.withColumns(staged)
        size_buy = _per(c("buy_add_vol"), c("n_buy"), 1)
        size_sell = _per(c("sell_add_vol"), c("n_sell"), 1)
        return d.withColumns({
            "tfi": _per(s, v),
            "ofi": _per((c("buy_add_vol") - c("buy_cancel_vol"))
                        - (c("sell_add_vol") - c("sell_cancel_vol")),
                        c("add_vol") + c("cancel_vol")),
            "signed_vol_20": _per(c("_s"), c("_v")),
            "cancel_ratio": _per(c("cancel_vol"), c("add_vol")),
            "cancel_skew": _per(c("buy_cancel_vol") - c("sell_cancel_vol"), c("cancel_vol")),
            "trade_to_order": _per(c("n_trades"), c("n_add")),
            "market_order_ratio": _per(c("n_market_order"), c("n_add")),
            "order_size_imb": _per(size_buy - size_sell, _per(c("add_vol"), c("n_add"), 1)),
            "trade_intensity": _per(c("n_trades"), c("_nt")),
            "avg_trade_size": _per(c("volume"), c("n_trades"), 1),
            "large_trade_share": _per(c("max_trade"), c("volume")),
            "rv_20": t.std(r, window, half),
            "mom_20": ratio(c("px"), t.lag(c("px"), window)) - 1,
            "rev_3": -(ratio(c("px"), t.lag(c("px"), 3)) - 1),
            "roll_spread": 2 * F.sqrt(at_least(c("_bounce"), 0.0)),
            "kyle_lambda": _per(c("_rs") - c("_mr") * c("_ms"), c("_var")),
            "amihud": _per(c("_abs_r"), c("_amt")),
            "vpin": _per(c("_abs_s"), c("_v")),
        }).drop("_lagret", *staged)

    return with_trailing(df, [SYMBOL], ["slot"], window + 2, build)


def build_book_features(panel: DataFrame, *, window: int = 20) -> DataFrame:
    """Book snapshots plus the features that need a reconstructed book."""
    require_columns(panel, ("slot", SYMBOL, "best_bid", "best_ask", "spread", "mid", "microprice"),
                    "build_book_features")
    two = (c("best_bid") > 0) & (c("best_ask") > 0)
    df = with_running(panel, [SYMBOL], ["slot"], {
        "_mid": ("last", F.when(two, c("mid"))),
        "_micro": ("last", F.when(two, c("microprice"))),
        "_spread": ("last", F.when(two, c("spread")))})
    half = window // 2
    depth = c("bid_depth5") + c("ask_depth5")

    def build(d: DataFrame, t: Trail) -> DataFrame:
        sp = c("_spread")
        d = d.withColumns({"_sp_m": t.mean(sp, window, half), "_sp_s": t.std(sp, window, half)})
        return d.withColumns({
            "micro_tilt": _per(c("_micro") - c("_mid"), sp),
            "imb_l1": c("imbalance_l1"), "imb_l5": c("imbalance_l5"),
            "rel_spread": _per(sp, c("_mid")),
            "order_count_imb": _per(c("n_bid_orders") - c("n_ask_orders"),
                                    c("n_bid_orders") + c("n_ask_orders")),
            "bid_order_size": _per(c("bid_depth5"), c("n_bid_orders"), 1),
            "ask_order_size": _per(c("ask_depth5"), c("n_ask_orders"), 1),
            "book_slope": _per(depth, c("bid_qty") + c("ask_qty")),
            "consumption": _per(c("slot_qty"), depth),
            "micro_mom_10": ratio(c("_micro"), t.lag(c("_micro"), 10)) - 1,
            "micro_rev_3": -(ratio(c("_micro"), t.lag(c("_micro"), 3)) - 1),
            # a spread that has not moved in the window is at its mean; rounding dust is no deviation
            "spread_z": F.when(c("_sp_s") > 1e-9, _per(sp - c("_sp_m"), c("_sp_s"))).when(c("_sp_s").isNotNull() & sp.isNotNull(), 0.0),
            "imb_persist": t.mean(c("imbalance_l1"), window, half),
        })

    return with_trailing(df, [SYMBOL], ["slot"], window, build).drop(
        "_mid", "_micro", "_spread", "_sp_m", "_sp_s")


def join_book(flow: DataFrame, book: DataFrame) -> DataFrame:
    """Book features onto the flow panel by (slot, symbol)."""
    return flow.join(book.select("slot", SYMBOL, *BOOK_FEATURES), ["slot", SYMBOL], "left")
