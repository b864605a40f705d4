"""Turning raw bar tables into an analysis panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SYMBOL, TS, finite, ratio, require_columns
from ..functions.ordered import (join_back, over_group, with_running,
                                 with_trailing)


def market_return(df: DataFrame, price: str = "adj_close", out: str = "mkt_ret") -> DataFrame:
    """Equal-weight market return: mean one-row return of the names present at each ``ts``."""
    df = with_trailing(df, [SYMBOL], [TS], 1, lambda d, t: d.withColumn(
        "_r1", ratio(F.col(price), t.lag(F.col(price))) - 1))
    return over_group(df, [TS], {out: F.avg("_r1")}).drop("_r1")


def clean_bars(df: DataFrame, tie_break: list[str]) -> DataFrame:
    """First row of each (symbol, date) in ``tie_break`` order; rows without a positive close go.

    Numeric fields may arrive as text: anything that does not parse drops the row.
    """
    require_columns(df, (SYMBOL, "date", "close"), "clean_bars")
    prices = [c for c in ("open", "high", "low", "close") if c in df.columns]
    sizes = [c for c in ("volume", "amount", "turnover") if c in df.columns]
    # the smallest row of a key is an aggregate, so duplicates are dropped before the shuffle
    rest = [c for c in df.columns if c not in (SYMBOL, "date")]
    first = df.groupBy(SYMBOL, "date").agg(
        F.min_by(F.struct(*rest), F.struct(*tie_break)).alias("_row"))
    out = first.select(SYMBOL, "date", "_row.*")
    out = out.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in prices + sizes})
    ok = F.col("close") > 0
    for c in prices:
        ok = ok & F.col(c).isNotNull()
    out = out.where(ok)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in sizes})


def prepare_daily(bars: DataFrame, reference: DataFrame, *, close_hour: int = 15,
                  seasoned_days: int = 400, grace_days: int = 5) -> DataFrame:
    """Analysis panel from raw daily bars (``date`` as yyyyMMdd, unadjusted prices, adj_factor).

    ``reference`` has ``symbol, industry, mcap``: the cap is back-cast with the shares implied
    by the last close.  A name present from the first days of the sample counts as seasoned.
    """
    require_columns(bars, ("date", SYMBOL, "close", "volume", "amount", "adj_factor"),
                    "prepare_daily")
    ts = (F.to_date("date", "yyyyMMdd").cast("timestamp_ntz")
          + F.make_dt_interval(hours=F.lit(close_hour)))
    df = bars.withColumn(TS, ts)
    ends = df.groupBy(SYMBOL).agg(F.max_by("close", TS).alias("_last"), F.min(TS).alias("_first"))
    start = df.select(F.min(TS).alias("t")).first()["t"]
    df = df.join(reference.select(SYMBOL, "industry", "mcap"), SYMBOL, "left")
    df = join_back(df, ends, [SYMBOL])
    t0 = F.lit(start).cast("timestamp_ntz")
    df = df.withColumns({
        "adj_close": F.col("close") * F.col("adj_factor"),
        "vwap": F.when(F.col("volume") > 0, ratio(F.col("amount"), F.col("volume")))
        .otherwise(F.col("close")),
        "log_volume": F.log(F.col("volume") + 1),
        "market_cap": ratio(F.col("mcap"), F.col("_last")) * F.col("close"),
        "list_date": F.when(F.col("_first") > t0 + F.make_dt_interval(days=F.lit(grace_days)),
                            F.col("_first"))
        .otherwise(t0 - F.make_dt_interval(days=F.lit(seasoned_days))),
    }).drop("_last", "_first")
    df = with_trailing(df, [SYMBOL], [TS], 1, lambda d, t: d.withColumn(
        "prev_close", t.lag(F.col("close"))))
    return market_return(df)


def index_level(market: DataFrame, *, base: float = 1000.0, code: str = "EW.MKT") -> DataFrame:
    """Index level compounded from ``(ts, ret)``; a missing return counts as zero."""
    require_columns(market, (TS, "ret"), "index_level")
    df = market.withColumn(SYMBOL, F.lit(code))
    df = with_running(df, [SYMBOL], [TS], {
        "_g": ("product", 1 + F.coalesce(F.col("ret"), F.lit(0.0)))})
    return df.select(TS, SYMBOL, (F.col("_g") * base).alias("close"), "ret")


def rebase_adjustment(df: DataFrame, raw: str = "close", adjusted: str = "qfq",
                      out: str = "adj_factor", decimals: int = 8) -> DataFrame:
    """Re-anchor a forward-adjusted price at the first bar: ``(q/raw) / first(q/raw)``.

    Rows without an adjusted price get 1.0.
    """
    require_columns(df, (TS, SYMBOL, raw, adjusted), "rebase_adjustment")
    r = F.when((F.col(raw) > 0) & (F.col(adjusted) != 0), ratio(F.col(adjusted), F.col(raw)))
    df = df.withColumn("_r", r)
    base = df.where(F.col("_r").isNotNull()).groupBy(SYMBOL).agg(
        F.min_by("_r", TS).alias("_base"))
    df = join_back(df, base, [SYMBOL])
    return df.withColumn(out, F.round(F.coalesce(
        ratio(F.col("_r"), F.col("_base")), F.lit(1.0)), decimals)).drop("_r", "_base")
