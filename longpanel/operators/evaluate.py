"""Factor evaluation: one job for many factors, keyed by ``(factor, ts)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (SYMBOL, TS, as_list, finite, is_finite, ratio, require_columns,
                                 sample_corr_from_sums, unpivot)
from ..functions.ordered import (BROADCAST_VALUES, CELLS_A_ROW, UNB, annotate, distinct_ordinals, durable, group_limit, is_hot,
                                 over_group, row_bound, value_bound, with_rank, with_running, with_trailing)

THIN_PERIODS = 30
"""Fewer periods than this and a summary is flagged thin."""

# Numbers of factors whose turnover is taken at once, and the fewest factors that are.
CELLS, FEWEST = 1 << 24, 2


def _as_series(df: DataFrame, name: str, n_ts: int) -> DataFrame:
    """A per-factor time series has at most one row per timestamp."""
    return annotate(df, {name: (n_ts, 0)})


def _long(df: DataFrame, factors: Sequence[str], extra: Sequence[str]) -> DataFrame:
    long = unpivot(df, [TS, SYMBOL, *extra], factors)
    return long.withColumn("value", finite(F.col("value")))


def ic(df: DataFrame, factors: str | Sequence[str], label: str, *, method: str = "spearman",
       min_names: int = 20) -> DataFrame:
    """``(factor, ts, ic, n)``: cross-sectional correlation of each factor with the label.

    Pairs with a missing side leave both ranks.  ``ic`` is NULL for thin or constant
    cross-sections; ``n`` is kept.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError(f"method must be 'spearman' or 'pearson', got {method!r}")
    cols = as_list(factors)
    require_columns(df, (TS, SYMBOL, label, *cols), "ic")
    n_ts = value_bound(df, TS)
    if method == "spearman" and _fits(df, len(cols) + 1):
        d = df.select(TS, finite(F.col(label).cast("double")).alias("_y"), *_values(cols)).where(F.col("_y").isNotNull())
        sums = _rank_sums(d, [(c, f"_x{i}", "_y") for i, c in enumerate(cols)])
        out = _corr_from_sums(sums, ["factor", TS], min_names)
    else:
        long = _long(df.withColumn("_y", finite(F.col(label).cast("double"))), cols, ["_y"])
        long = long.where(F.col("value").isNotNull() & F.col("_y").isNotNull())
        out = _pair_corr(long, ["factor", TS], "value", "_y", method, min_names)
    return _as_series(out.select("factor", TS, "ic", "n"), "factor", n_ts)


def _fits(df: DataFrame, columns: int) -> bool:
    """Whether a task can hold so many numbers of each row of a stamp."""
    return row_bound(df, [TS]) * columns <= CELLS_A_ROW * group_limit(df.sparkSession)


def _values(cols: Sequence[str]) -> list[Column]:
    return [finite(F.col(c).cast("double")).alias(f"_x{i}") for i, c in enumerate(cols)]


def _a_stamp(stamp: pa.Table, n: int) -> pa.Array:
    return stamp.column(TS).combine_chunks().take(pa.array(np.zeros(n, dtype=np.int64)))


def _average_ranks(v: np.ndarray) -> np.ndarray:
    order = np.argsort(v)
    s = v[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(first, len(s)))
    out = np.empty(len(v))
    out[order] = np.repeat(first + (size + 1) / 2, size)
    return out


_SUMS = ("_sx", "_sy", "_sxx", "_syy", "_sxy")


def _rank_sums(d: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``(factor, ts, n, <power sums>)`` of the ranks of two columns within ``ts``, for each ``(factor, column, column)``.

    A row goes to its stamp once, with all factors side by side, where rows a factor would repeat stamp and label.
    """
    schema = T.StructType([T.StructField("factor", T.StringType()), d.schema[TS], T.StructField("n", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in _SUMS]])

    def one(stamp: pa.Table) -> pa.Table:
        ranks: dict[tuple, np.ndarray] = {}  # of the last second column: many factors are missing on the same rows
        found, sums = [], []
        for name, a, b in pairs:
            x, y = stamp.column(a).to_numpy(), stamp.column(b).to_numpy()
            there = ~(np.isnan(x) | np.isnan(y))
            if not there.any():
                continue
            key = (b, np.packbits(there).tobytes())
            if key not in ranks:
                ranks = {key: _average_ranks(y[there])}
            u, v = _average_ranks(x[there]), ranks[key]
            found.append(name)
            sums.append([len(u), u.sum(), v.sum(), u @ u, v @ v, u @ v])
        s = np.array(sums).reshape(len(found), 6)
        return pa.table([pa.array(found, pa.string()), _a_stamp(stamp, len(found)), pa.array(s[:, 0].astype(np.int64)),
                         *[pa.array(s[:, k]) for k in range(1, 6)]], names=["factor", TS, "n", *_SUMS])

    return d.groupBy(TS).applyInArrow(one, schema)


def _bucket_means(d: DataFrame, cols: Sequence[str], n: int, floor: int) -> DataFrame:
    """:func:`bucketed` with equal weights: a row goes to its stamp once."""
    schema = T.StructType([T.StructField("factor", T.StringType()), d.schema[TS], T.StructField("bucket", T.IntegerType()),
                           T.StructField("ret", T.DoubleType()), T.StructField("n", T.LongType())])
    names = list(cols)

    def one(stamp: pa.Table) -> pa.Table:
        y = stamp.column("_y").to_numpy()
        ties = np.empty(len(y), dtype=np.int64)
        ties[pc.array_sort_indices(stamp.column(SYMBOL).combine_chunks(), null_placement="at_start").to_numpy()] = np.arange(len(y))
        parts = []
        for k, name in enumerate(names):
            x = stamp.column(f"_x{k}").to_numpy()
            at = np.flatnonzero(~np.isnan(x))
            if not len(at) or len(at) < floor:
                continue
            at = at[np.lexsort((ties[at], x[at]))]
            bucket = np.minimum(np.arange(len(at)) * n // len(at), n - 1)
            size = np.bincount(bucket, minlength=n)
            total = np.bincount(bucket, weights=y[at], minlength=n)
            parts += [(name, b, total[b] / size[b], size[b]) for b in np.flatnonzero(size)]
        f, b, r, c = zip(*parts) if parts else ((), (), (), ())
        return pa.table([pa.array(f, pa.string()), _a_stamp(stamp, len(f)), pa.array(b, pa.int32()), pa.array(r, pa.float64()),
                         pa.array(c, pa.int64())], names=["factor", TS, "bucket", "ret", "n"])

    return d.groupBy(TS).applyInArrow(one, schema)


def _pair_corr(long: DataFrame, by: list[str], x: str, y: str, method: str,
               min_names: int) -> DataFrame:
    if method == "spearman":
        long = with_rank(long, by, x, "_rx")
        long = with_rank(long, by, y, "_ry")
        x, y = "_rx", "_ry"
    a, b = F.col(x), F.col(y)
    g = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("_sx"), F.sum(b).alias("_sy"),
        F.sum(a * a).alias("_sxx"), F.sum(b * b).alias("_syy"), F.sum(a * b).alias("_sxy"))
    return _corr_from_sums(g, by, min_names)


def _corr_from_sums(g: DataFrame, by: list[str], min_names: int) -> DataFrame:
    c = sample_corr_from_sums(F.col("n"), F.col("_sx"), F.col("_sy"), F.col("_sxx"),
                              F.col("_syy"), F.col("_sxy"))
    return g.select(*by, F.when(F.col("n") >= min_names, c).alias("ic"), "n")


def ic_summary(series: DataFrame, *, newey_west_lags: int = 0,
               by: str = "factor") -> DataFrame:
    """One row per factor: mean, std, icir, t_stat, positive_rate, n_periods, mean_breadth.

    ``newey_west_lags > 0`` corrects the t statistic with a Bartlett kernel; use horizon - 1
    when label windows overlap.
    """
    require_columns(series, (by, TS, "ic", "n"), "ic_summary")
    # aggregates pass over a NULL ic, so one of them serves thin periods and the others
    s = series.where(F.col("ic").isNotNull())
    out = stats = series.groupBy(by).agg(
        F.avg("n").alias("mean_breadth"),
        F.avg("ic").alias("mean"), F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("std"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive_rate"),
        F.count("ic").alias("n_periods"))
    if newey_west_lags > 0:
        out = out.join(_long_run_variance(s, stats, newey_west_lags, by), by, "left")
        t = ratio(F.col("mean"), F.sqrt(ratio(F.col("_lrv"), F.col("n_periods"))))
    else:
        t = ratio(F.col("mean"), F.col("std")) * F.sqrt("n_periods")
    sd_ok = F.col("std") > 1e-15
    zero = F.lit(0.0)
    return out.select(
        by,
        F.coalesce("mean", zero).alias("mean"),
        F.coalesce("std", zero).alias("std"),
        F.coalesce(F.when(sd_ok, ratio(F.col("mean"), F.col("std"))), zero).alias("icir"),
        F.coalesce(F.when(sd_ok & (F.col("n_periods") >= 2), t), zero).alias("t_stat"),
        F.coalesce("positive_rate", zero).alias("positive_rate"),
        F.coalesce("n_periods", F.lit(0)).cast("bigint").alias("n_periods"),
        F.coalesce("mean_breadth", zero).alias("mean_breadth"),
        (F.coalesce("n_periods", F.lit(0)) < THIN_PERIODS).alias("is_thin"),
    )


def _long_run_variance(s: DataFrame, stats: DataFrame, lags: int, by: str) -> DataFrame:
    """``gamma0 + 2 * sum_k (1 - k/(L+1)) gamma_k`` per factor, floored."""
    dev = s.join(stats.select(by, "mean"), by).withColumn("_d", F.col("ic") - F.col("mean"))

    def build(d, t):
        return d.withColumns({f"_g{k}": F.col("_d") * t.lag(F.col("_d"), k)
                              for k in range(1, lags + 1)})

    dev = with_trailing(dev, [by], [TS], lags, build)
    n = F.count(F.lit(1))
    total = F.sum(F.col("_d") * F.col("_d")) / n
    for k in range(1, lags + 1):
        g = F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)) / n
        total = total + F.lit(2.0 * (1.0 - k / (lags + 1.0))) * g
    return dev.groupBy(by).agg(F.greatest(total, F.lit(1e-24)).alias("_lrv"))


def bucketed(df: DataFrame, factors: str | Sequence[str], label: str, n: int, *,
             min_names: int | None = None, weight: str | None = None) -> DataFrame:
    """``(factor, ts, bucket, ret, n)``: weighted mean label of each rank bucket."""
    if n < 2:
        raise ValueError(f"need at least 2 buckets, got {n}")
    cols = as_list(factors)
    require_columns(df, (TS, SYMBOL, label, *cols) + ((weight,) if weight else ()),
                    "quantile_returns")
    floor = 2 * n if min_names is None else min_names
    if weight is None and _fits(df, len(cols) + 3):
        d = df.select(TS, SYMBOL, finite(F.col(label).cast("double")).alias("_y"), *_values(cols))
        return _bucket_means(d.where(F.col("_y").isNotNull()), cols, n, floor)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = _long(df.withColumns({"_y": finite(F.col(label).cast("double")), "_w": w}), cols,
                 ["_y", "_w"])
    long = long.where(F.col("value").isNotNull() & F.col("_y").isNotNull())
    by = ["factor", TS]
    long = with_rank(long, by, "value", "_r", kind="ordinal", ties=[SYMBOL])
    long = over_group(long, by, {"_n": F.count(F.lit(1))}).where(F.col("_n") >= floor)
    long = long.withColumn("bucket", F.expr(f"int(least(((_r - 1) * {n}) div _n, {n - 1}))"))
    return long.groupBy(*by, "bucket").agg(
        ratio(F.sum(F.col("_y") * F.col("_w")), F.sum("_w")).alias("ret"),
        F.count(F.lit(1)).alias("n"))


def quantile_curves(per_period: DataFrame, n_ts: int) -> DataFrame:
    """Cumulative return of every bucket."""
    df = per_period.withColumn("_series", F.concat_ws("#", "factor", "bucket"))
    df = annotate(df, {"_series": (n_ts, 0)})
    df = with_running(df, ["_series"], [TS], {"_g": ("product", 1 + F.col("ret"))})
    return df.withColumn("cum_ret", F.col("_g") - 1).drop("_series", "_g")


def quantile_spread(per_period: DataFrame, n: int, n_ts: int) -> DataFrame:
    """Top minus bottom bucket per period, with its compounded path."""
    top = F.max(F.when(F.col("bucket") == n - 1, F.col("ret")))
    bottom = F.max(F.when(F.col("bucket") == 0, F.col("ret")))
    s = per_period.groupBy("factor", TS).agg((top - bottom).alias("spread"))
    s = _as_series(s.where(F.col("spread").isNotNull()), "factor", n_ts)
    s = with_running(s, ["factor"], [TS], {"_g": ("product", 1 + F.col("spread"))})
    return s.withColumn("cum_spread", F.col("_g") - 1).drop("_g")


def quantile_buckets(per_period: DataFrame) -> DataFrame:
    """Mean period return and observation count per bucket."""
    return per_period.groupBy("factor", "bucket").agg(
        F.avg("ret").alias("mean_ret"), F.sum("n").cast("bigint").alias("n"))


def quantile_summary(per_period: DataFrame, n: int, n_ts: int) -> DataFrame:
    """One row per factor: monotonicity, mean spread, spread Sharpe, periods."""
    b = quantile_buckets(per_period)
    b = annotate(b, {"factor": (n, 0)})
    b = with_rank(b, ["factor"], "mean_ret", "_r")
    x, y = F.col("bucket").cast("double"), F.col("_r")
    mono = b.groupBy("factor").agg(F.coalesce(sample_corr_from_sums(
        F.count(F.lit(1)), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)),
        F.lit(0.0)).alias("monotonicity"))
    s = quantile_spread(per_period, n, n_ts).groupBy("factor").agg(
        F.avg("spread").alias("spread_mean"),
        F.coalesce(F.stddev_samp("spread"), F.lit(0.0)).alias("_sd"),
        F.count(F.lit(1)).alias("n_periods"))
    return mono.join(s, "factor", "left").select(
        "factor", "monotonicity", F.coalesce("spread_mean", F.lit(0.0)).alias("spread_mean"),
        F.coalesce(F.when(F.col("_sd") > 0, ratio(F.col("spread_mean"), F.col("_sd"))),
                   F.lit(0.0)).alias("spread_sharpe"),
        F.coalesce("n_periods", F.lit(0)).cast("bigint").alias("n_periods"),
        (F.coalesce("n_periods", F.lit(0)) < THIN_PERIODS).alias("is_thin"))


def decay(df: DataFrame, factor: str, labels_by_horizon: Mapping[int, str], *,
          method: str = "spearman", min_names: int = 20) -> DataFrame:
    """``(horizon, ic, t_stat, n_periods)`` with Newey-West lags of ``horizon - 1``.

    All horizons are scored in one job: the labels are unpivoted and keyed by ``(horizon, ts)``.
    """
    if not labels_by_horizon:
        raise ValueError("labels_by_horizon is empty")
    require_columns(df, (TS, SYMBOL, factor, *labels_by_horizon.values()), "decay")
    n_ts = value_bound(df, TS)
    long = df.withColumn("_x", finite(F.col(factor).cast("double"))).select(
        TS, "_x", F.explode(F.array(*[
            F.struct(F.lit(int(h)).alias("horizon"), F.col(c).cast("double").alias("y"))
            for h, c in labels_by_horizon.items()])).alias("_l"),
    ).select(TS, "_x", "_l.horizon", finite(F.col("_l.y")).alias("_y"))
    long = long.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    series = _as_series(_pair_corr(long, ["horizon", TS], "_x", "_y", method, min_names),
                        "horizon", n_ts)
    # one lineage from the series to the result, so the ranks are made once
    dev = over_group(series.where(F.col("ic").isNotNull()), ["horizon"], {
        "_mean": F.avg("ic"), "_std": F.stddev_samp("ic")}).withColumn("_d", F.col("ic") - F.col("_mean"))
    longest = max(labels_by_horizon) - 1

    def build(d, t):
        total = F.col("_d") * F.col("_d")
        for k in range(1, longest + 1):
            # lag k counts only for horizons longer than k, with Bartlett weight 1 - k/horizon
            wgt = F.when(F.col("horizon") > k, 2.0 * (1.0 - F.lit(float(k)) / F.col("horizon")))
            total = total + F.coalesce(wgt * F.col("_d") * t.lag(F.col("_d"), k), F.lit(0.0))
        return d.withColumn("_g", total)

    dev = with_trailing(dev, ["horizon"], [TS], max(longest, 1), build)
    n = F.count(F.lit(1))
    stats = dev.groupBy("horizon").agg(
        F.max("_mean").alias("mean"), F.max("_std").alias("std"), n.alias("n_periods"),
        F.greatest(F.sum("_g") / n, F.lit(1e-24)).alias("_lrv"))
    # without overlap the plain sample standard deviation applies
    se = F.when(F.col("horizon") > 1, F.sqrt(ratio(F.col("_lrv"), F.col("n_periods")))).otherwise(
        ratio(F.col("std"), F.sqrt("n_periods")))
    horizons = df.sparkSession.createDataFrame(
        [(int(h),) for h in labels_by_horizon], "horizon int")
    return horizons.join(stats, "horizon", "left").select(
        "horizon", F.coalesce("mean", F.lit(0.0)).alias("ic"),
        F.coalesce(F.when(F.col("std") > 0, ratio(F.col("mean"), se)), F.lit(0.0)).alias("t_stat"),
        F.coalesce("n_periods", F.lit(0)).cast("bigint").alias("n_periods"))


def half_life(curve: DataFrame) -> DataFrame:
    """Peak of ``abs(ic)`` and the interpolated horizon where it first halves afterwards.

    ``half_life`` is infinite when the curve never halves.  The curve has one row per horizon.
    """
    a = curve.withColumn("_a", F.abs("ic")).withColumn("_all", F.lit(1))
    a = annotate(a, {"_all": (1, 1)})
    peak = a.groupBy("_all").agg(
        F.max_by("horizon", F.struct("_a", -F.col("horizon"))).alias("peak_horizon"),
        F.max_by("ic", F.struct("_a", -F.col("horizon"))).alias("peak_ic"),
        F.max("_a").alias("_top"))

    def build(d, t):
        return d.withColumns({"_x0": t.lag(F.col("horizon")), "_y0": t.lag(F.col("_a"))})

    steps = with_trailing(a, ["_all"], ["horizon"], 1, build).join(peak, "_all")
    target = F.col("_top") / 2
    hit = (F.col("horizon") > F.col("peak_horizon")) & (F.col("_a") <= target) & (F.col("_top") > 0)
    x0, x1 = F.col("_x0").cast("double"), F.col("horizon").cast("double")
    y0, y1 = F.col("_y0"), F.col("_a")
    at = F.when(y0 == y1, x1).otherwise(x0 + ratio((y0 - target) * (x1 - x0), y0 - y1))
    return steps.groupBy("peak_horizon", "peak_ic").agg(
        F.coalesce(F.min_by(F.when(hit, at), F.when(hit, F.col("horizon"))),
                   F.lit(float("inf"))).alias("half_life"))


def _repeats(df: DataFrame) -> bool:
    """Whether a symbol has several rows at a stamp."""
    keys = df.select(TS, SYMBOL).groupBy(TS, SYMBOL).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1)
    return durable(keys.limit(1)).count() > 0


def _stamp_before(df: DataFrame, cols: Sequence[str], min_names: int, n_ts: int) -> DataFrame:
    """Rank sums of each factor with its own value at the kept stamp before.

    Ranks of the names that both stamps have are those of the values, whatever their ranks among all names are.
    """
    d = df.select(TS, SYMBOL, *_values(cols)).where(F.col(TS).isNotNull())
    k = range(len(cols))
    stamps = d.groupBy(TS).agg(*[(F.count(f"_x{i}") >= min_names).alias(f"_kept{i}") for i in k]).withColumn("_all", F.lit(1))
    stamps = with_running(annotate(stamps, {"_all": (n_ts, 1)}), ["_all"], [TS], {
        f"_k{i}": ("sum", F.when(F.col(f"_kept{i}"), 1.0)) for i in k})
    stamps = durable(stamps.select(TS, *[F.when(F.col(f"_kept{i}"), F.col(f"_k{i}")).alias(f"_k{i}") for i in k]))
    d = d.where(F.col(SYMBOL).isNotNull())
    # numbers of stamps are looked up where the rows are wanted next, so that they need not travel
    d = d.repartition(SYMBOL).join(F.broadcast(stamps), TS) if n_ts <= BROADCAST_VALUES else d.join(stamps, TS)
    before = W.partitionBy(SYMBOL).orderBy(TS).rowsBetween(UNB, -1)
    there = [F.col(f"_x{i}").isNotNull() & F.col(f"_k{i}").isNotNull() for i in k]
    d = d.withColumns({f"_l{i}": F.last(F.when(there[i], F.struct(f"_k{i}", f"_x{i}")), ignorenulls=True).over(before) for i in k})
    d = d.select(TS, *[f"_x{i}" for i in k], *[
        F.when(F.col(f"_l{i}._k{i}") == F.col(f"_k{i}") - 1, F.col(f"_l{i}._x{i}")).alias(f"_p{i}") for i in k])
    return _rank_sums(d, [(c, f"_p{i}", f"_x{i}") for i, c in enumerate(cols)])


def turnover(df: DataFrame, factors: str | Sequence[str], *, min_names: int = 20) -> DataFrame:
    """``(factor, ts, turnover, n)``: ``1 - rank correlation`` between consecutive kept stamps.

    Names are matched within the history of their symbol; when one is too long for a task, or keys repeat, through an
    equi-join on ``(factor, symbol, stamp ordinal)``.
    """
    cols = as_list(factors)
    require_columns(df, (TS, SYMBOL, *cols), "turnover")
    n_ts = value_bound(df, TS)
    if _fits(df, 2 * len(cols)) and not is_hot(df, [SYMBOL]) and not _repeats(df):
        c = _corr_from_sums(_stamp_before(df, cols, min_names, n_ts), ["factor", TS], min_names)
        out = c.where(F.col("ic").isNotNull()).select("factor", TS, (1 - F.col("ic")).alias("turnover"), "n")
        return _as_series(out, "factor", n_ts)
    long = _long(df, cols, []).where(F.col("value").isNotNull())
    # the ranks are read by three branches below
    ranked = durable(with_rank(long, ["factor", TS], "value", "_rank").select("factor", TS, SYMBOL, "_rank"))
    kept = ranked.groupBy("factor", TS).agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") >= min_names)
    kept = _as_series(kept, "factor", n_ts)
    stamps = with_running(kept, ["factor"], [TS], {"_k": ("sum", F.lit(1.0))}).select(
        "factor", TS, F.col("_k").cast("bigint").alias("_k"))
    ranked = ranked.join(stamps, ["factor", TS])
    prev = ranked.select("factor", SYMBOL, (F.col("_k") + 1).alias("_k"),
                         F.col("_rank").alias("_prev"))
    both = ranked.select("factor", SYMBOL, "_k", TS, F.col("_rank").alias("_cur")).join(
        prev, ["factor", SYMBOL, "_k"])
    c = _pair_corr(both, ["factor", TS], "_prev", "_cur", "spearman", min_names)
    out = c.where(F.col("ic").isNotNull()).select(
        "factor", TS, (1 - F.col("ic")).alias("turnover"), "n")
    return _as_series(out, "factor", n_ts)


def turnover_summary(series: DataFrame) -> DataFrame:
    """Mean, deviation and implied holding period (``1 / mean``) per factor."""
    return series.groupBy("factor").agg(
        F.avg("turnover").alias("mean"),
        F.coalesce(F.stddev_samp("turnover"), F.lit(0.0)).alias("std"),
        F.count(F.lit(1)).alias("n_periods"),
    ).withColumns({
        "implied_holding": F.when(F.col("mean") > 0, ratio(F.lit(1.0), F.col("mean")))
        .otherwise(F.lit(float("inf"))),
        "is_thin": F.col("n_periods") < THIN_PERIODS})


def factor_ranking(df: DataFrame, factors: Sequence[str], label: str, *, buckets: int = 5,
                   min_names: int = 20, written: bool = False) -> DataFrame:
    """IC, turnover and bucket statistics of every factor in one table.  ``written``: ``df`` is a table, not a derivation."""
    n_ts = value_bound(df, TS)
    # read by the branches below: written once, with the columns that they use
    df = df if written else durable(df.select(TS, SYMBOL, *dict.fromkeys([*factors, label])))
    # each series is written, so that what one shuffles is gone before the next begins
    s = ic_summary(durable(ic(df, factors, label, min_names=min_names))).select(
        "factor", F.col("mean").alias("ic"), "icir", "t_stat",
        F.col("positive_rate").alias("pos_rate"), F.col("n_periods").alias("periods"),
        F.col("mean_breadth").alias("breadth"))
    size = max(FEWEST, CELLS // max(1, df.count()))
    parts = [durable(turnover(df, factors[i:i + size], min_names=min_names)) for i in range(0, len(factors), size)]
    t = turnover_summary(reduce(DataFrame.unionByName, parts)).select(
        "factor", F.col("mean").alias("turnover"))
    q = quantile_summary(durable(bucketed(df, factors, label, buckets)), buckets, n_ts).select(
        "factor", F.col("spread_mean").alias("q_spread"), F.col("monotonicity").alias("monotonic"))
    return s.join(t, "factor", "left").join(q, "factor", "left").withColumn(
        "abs_icir", F.abs("icir"))


def coverage(df: DataFrame, factors: Sequence[str], *, low: float = 0.5) -> DataFrame:
    """Share of non-null values of each factor over the panel, and whether it is low."""
    require_columns(df, factors, "coverage")
    n = F.count(F.lit(1))
    one = df.agg(n.alias("_n"), *[F.count(c).alias(c) for c in factors])
    return unpivot(one.withColumn("_n", F.col("_n").cast("bigint")), ["_n"], factors).select(
        "factor", ratio(F.col("value"), F.col("_n")).alias("coverage"),
    ).withColumn("is_low", F.col("coverage") < low)


def conditional_return_by_quantile(df: DataFrame, signal: str, label: str, n: int = 5, *,
                                   series: str = "series", min_obs: int = 30) -> DataFrame:
    """Whole-sample buckets of one signal per series: ``bucket, lo, hi, mean_ret, n``.

    Series with fewer than ``min_obs`` usable rows are left out.
    """
    if n < 2:
        raise ValueError(f"need at least 2 buckets, got {n}")
    x, y = finite(F.col(signal).cast("double")), finite(F.col(label).cast("double"))
    d = df.withColumns({"_x": x, "_y": y}).where(
        F.col("_x").isNotNull() & F.col("_y").isNotNull())
    d = with_rank(d, [series], "_x", "_r", kind="ordinal", ties=[TS])
    d = over_group(d, [series], {"_n": F.count(F.lit(1))}).where(F.col("_n") >= min_obs)
    d = d.withColumn("bucket", F.expr(f"int(least(((_r - 1) * {n}) div _n, {n - 1}))"))
    return d.groupBy(series, "bucket").agg(
        F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.avg("_y").alias("mean_ret"),
        F.count(F.lit(1)).alias("n"))


def rolling_corr(df: DataFrame, a: str, b: str, window: int, *, series: str = "series",
                 min_periods: int | None = None) -> DataFrame:
    """Trailing correlation of two columns of each series."""
    if window < 2:
        raise ValueError(f"a correlation over {window} rows is undefined")
    require_columns(df, (series, TS, a, b), "rolling_corr")
    return with_trailing(df, [series], [TS], window, lambda d, t: d.withColumn(
        "corr", t.corr(F.col(a), F.col(b), window, min_periods))).select(series, TS, "corr")


def parameter_surface(scores: DataFrame, axes: Sequence[str], *,
                      plateau_threshold: float = 0.6) -> DataFrame:
    """Judge a scored parameter grid: best point, mean of its neighbours, isolated or plateau.

    ``scores`` has one row per combination: the axis columns and ``score``.  A neighbour differs
    by one step on exactly one axis.  Returns one row.
    """
    require_columns(scores, (*axes, "score"), "parameter_surface")
    g = scores
    for a in axes:
        steps = distinct_ordinals(scores, a, f"_o_{a}")
        g = g.join(steps, a)
    order = F.struct("score", *[-F.col(f"_o_{a}") for a in axes])
    best = g.where(F.col("score").isNotNull() & ~F.isnan("score")).agg(
        F.max_by(F.struct(*axes, *[F.col(f"_o_{a}") for a in axes], "score"), order).alias("b"))
    best = best.select(*[F.col(f"b.{a}").alias(f"best_{a}") for a in axes],
                       *[F.col(f"b._o_{a}").alias(f"_b_{a}") for a in axes],
                       F.col("b.score").alias("best_score"), F.lit(1).alias("_one"))
    gap = sum((F.abs(F.col(f"_o_{a}") - F.col(f"_b_{a}")) for a in axes), F.lit(0))
    table = g.withColumn("_one", F.lit(1)).join(best, "_one")
    near = F.when(gap == 1, F.col("score"))
    plateau = F.coalesce(F.when(F.col("best_score") > 0, ratio(F.col("_near"), F.col("best_score"))),
                         F.lit(0.0))
    return table.groupBy(*[f"best_{a}" for a in axes], "best_score").agg(
        F.avg(near).alias("_near"), F.count(F.lit(1)).alias("n_points")).select(
        *[f"best_{a}" for a in axes], "best_score", plateau.alias("plateau_score"),
        (F.col("_near").isNotNull() & (plateau < plateau_threshold)).alias("is_isolated_peak"),
        "n_points")
