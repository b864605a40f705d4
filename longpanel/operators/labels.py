"""Forward labels.  The future is addressed by slot number, never by row offset, so a symbol
that misses a slot gets NULL instead of a later price."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import PointInTimeError
from ..functions.columns import SYMBOL, TS, as_list, ratio, require_columns
from ..functions.ordered import distinct_ordinals, is_hot, join_back, with_ordinal, with_trailing


def slot_index(df: DataFrame, ts: str = TS, out: str = "_slot") -> DataFrame:
    """Dense ordinal of each distinct timestamp over the whole panel."""
    return with_ordinal(df, ts, out)


def _check_price(df: DataFrame, price: str) -> None:
    require_columns(df, (TS, SYMBOL, price), "forward_return")
    if price == "close":
        warnings.warn("close-to-close labels assume a fill at the closing print; prefer vwap",
                      UserWarning, stacklevel=3)


def forward_returns(df: DataFrame, horizons: Mapping[str, int], price: str = "vwap", *,
                    entry_lag: int = 1, ts: str = TS) -> DataFrame:
    """``label -> n``: ``price[slot+lag+n] / price[slot+lag] - 1`` for every label at once.

    All horizons share one Exchange on ``symbol``.  When one symbol is too long for a task the
    prices are looked up by an equi-join on ``(symbol, slot)``, which has no hot key.
    """
    if entry_lag < 0 or any(n < 1 for n in horizons.values()):
        raise ValueError("need entry_lag >= 0 and every horizon >= 1")
    base = slot_index(df, ts)
    px = F.col(price)
    offsets = sorted({entry_lag, *[entry_lag + n for n in horizons.values()]})
    if is_hot(df, [SYMBOL]):
        # rows that share a key share its price: one row a key, so that no join multiplies them
        at = base.groupBy(SYMBOL, "_slot").agg(F.max(px).alias("_v"))
        for k in offsets:
            shifted = at.select(SYMBOL, (F.col("_slot") - k).alias("_slot"),
                                F.col("_v").alias(f"_p{k}"))
            base = join_back(base, shifted, [SYMBOL, "_slot"])
    else:
        w = W.partitionBy(SYMBOL).orderBy("_slot")
        base = base.withColumns(
            {f"_p{k}": F.max(px).over(w.rangeBetween(k, k)) for k in offsets})
    entry = F.col(f"_p{entry_lag}")
    return base.withColumns({
        label: F.when(entry > 0, ratio(F.col(f"_p{entry_lag + n}"), entry) - 1)
        for label, n in horizons.items()
    }).drop("_slot", *[f"_p{k}" for k in offsets])


def forward_return(df: DataFrame, n: int = 1, price: str = "vwap", *, entry_lag: int = 1,
                   label: str = "fwd_ret") -> DataFrame:
    """Forward return over ``n`` slots, entered ``entry_lag`` slots after the decision."""
    _check_price(df, price)
    return forward_returns(df, {label: n}, price, entry_lag=entry_lag)


def vol_normalized_return(df: DataFrame, n: int = 1, price: str = "vwap", *,
                          vol_window: int = 20, entry_lag: int = 1,
                          label: str = "fwd_ret_vol", min_periods: int | None = None) -> DataFrame:
    """Forward return over trailing volatility of one-row returns, scaled by ``sqrt(n)``."""
    out = forward_return(df, n, price, entry_lag=entry_lag, label="_fwd")

    def build(d, t):
        d = d.withColumn("_r", ratio(F.col(price), t.lag(F.col(price))) - 1)
        return d.withColumn("_vol", t.std(F.col("_r"), vol_window, min_periods))

    out = with_trailing(out, [SYMBOL], [TS], vol_window + 1, build)
    return out.withColumn(label, F.when(
        F.col("_vol") > 0, ratio(F.col("_fwd"), F.col("_vol") * F.lit(float(n) ** 0.5)))
    ).drop("_fwd", "_r", "_vol")


def ternary_label(df: DataFrame, n: int = 1, price: str = "vwap", *, threshold: float = 0.005,
                  entry_lag: int = 1, label: str = "y3") -> DataFrame:
    """-1 / 0 / +1 around a symmetric dead band; NULL where the forward return is NULL."""
    if threshold < 0:
        raise ValueError(f"threshold must be >= 0, got {threshold}")
    out = forward_return(df, n, price, entry_lag=entry_lag, label="_fwd")
    f = F.col("_fwd")
    return out.withColumn(label, F.when(f.isNull(), None).when(f > threshold, 1)
                          .when(f < -threshold, -1).otherwise(0).cast("tinyint")).drop("_fwd")


def overlap_report(features: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: distinct feature keys and how many of them have no label row."""
    fk = features.select(TS, SYMBOL).distinct()
    lk = labels.select(TS, SYMBOL).distinct().withColumn("_hit", F.lit(1))
    return fk.join(lk, [TS, SYMBOL], "left").agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)), F.lit(0))
        .cast("bigint").alias("n_orphans"))


def assert_no_overlap(features: DataFrame, labels: DataFrame, *, n: int, entry_lag: int = 1,
                      feature_cols: Sequence[str] | None = None) -> None:
    """Raise unless the label window opens strictly after the feature stamp."""
    if entry_lag < 1:
        raise PointInTimeError(f"entry_lag={entry_lag}: the entry price is already complete at "
                               "the feature stamp and cannot be traded")
    if n < 1:
        raise PointInTimeError(f"label horizon n={n} does not extend into the future")
    if feature_cols:
        missing = [c for c in feature_cols if c not in features.columns]
        if missing:
            raise PointInTimeError(f"declared feature column(s) {missing} absent from features")
    r = overlap_report(features, labels).first()
    if r["n_keys"] and r["n_keys"] == r["n_orphans"]:
        raise PointInTimeError("features and labels share no (ts, symbol) key: misaligned join")


def advance_to_executable(df: DataFrame, ts: str = TS) -> DataFrame:
    """Move each row to the next distinct timestamp; rows of the last one drop out."""
    ords = distinct_ordinals(df, ts)
    nxt = ords.join(ords.select(F.col(ts).alias("_next"), (F.col("_ord") - 1).alias("_ord")),
                    "_ord").select(ts, "_next")
    cols = [F.col("_next").alias(ts) if c == ts else F.col(c) for c in df.columns]
    return df.join(nxt, ts).select(*cols)
