"""Daily formula features: 36 trailing formulas over bars.

All windows are trailing per symbol and share one Exchange on ``symbol``; their statistics come from one
pass over Arrow batches.  The three formulas that consume cross-sectional ranks read rank columns made in an earlier pass over ``ts``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partialmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SYMBOL, TS, finite, ratio, require_columns, sign
from ..functions.ordered import Trail, durable, over_group, with_rank, with_trailing

REQUIRED = ("open", "high", "low", "close", "adj_close", "volume", "amount", "turnover", "vwap",
            "log_volume", "market_cap", "mkt_ret")



class _Formulas(Trail):
    """Names the window statistics that formulas ask for, so that all of them come from one pass; lags stay expressions."""

    def __init__(self, trail: Trail):
        super().__init__(trail.keys, trail.order)
        self.specs: dict[str, tuple] = {}
        self.asked = 0

    def _stat(self, kind: str, *args) -> Column:
        name = "_".join(["", "t", kind, *map(str, args)])
        self.specs[name] = (kind, *args)
        self.asked += 1
        return F.col(name)

    def dev3(self, x: str, n: int) -> str:
        """Name of the cubed deviations from a trailing mean."""
        self.mean(x, n)
        self.specs[f"_dev3_{x}_{n}"] = (lambda v, m: (v - m) ** 3, x, f"_t_mean_{x}_{n}")
        return f"_dev3_{x}_{n}"


for _kind in ("mean", "sum", "std", "max", "min", "corr", "below"):
    setattr(_Formulas, _kind, partialmethod(_Formulas._stat, _kind))

Builder = Callable[[_Formulas], Column]
_FEATURES: dict[str, tuple[str, Builder]] = {}
# Longest look-back of any formula, including the row the return is taken from.
REACH = 61


def _feature(name: str, family: str):
    def deco(fn: Builder) -> Builder:
        _FEATURES[name] = (family, fn)
        return fn
    return deco


c = F.col


def _back(t: Trail, n: int) -> Column:
    return t.lag(c("adj_close"), n)


def _ret(t: Trail, n: int) -> Column:
    return ratio(c("adj_close"), _back(t, n)) - 1


def _body() -> Column:
    """Position of the close within the bar, before scaling."""
    return (c("close") - c("low")) - (c("high") - c("close"))


def _cube(x: Column) -> Column:
    return x * x * x


def _fifth(x: Column) -> Column:
    return x * x * x * x * x


_feature("rev_5", "trad")(lambda t: -_ret(t, 5))
_feature("rev_20", "trad")(lambda t: -_ret(t, 20))
_feature("mom_60_20", "trad")(lambda t: ratio(_back(t, 20), _back(t, 60)) - 1)
_feature("vol_20", "trad")(lambda t: t.std("_r1", 20))
_feature("beta_60", "trad")(lambda t: ratio(
    t.corr("_r1", "mkt_ret", 60) * t.std("_r1", 60), t.std("mkt_ret", 60)))
_feature("ivol_20", "trad")(lambda t: t.std("_excess", 20))
_feature("turn_20", "trad")(lambda t: t.mean("turnover", 20))
_feature("turn_bias", "trad")(lambda t: ratio(t.mean("turnover", 20),
                                              t.mean("turnover", 60)) - 1)
_feature("illiq", "trad")(lambda t: t.mean("_impact", 20) * 1e9)
_feature("size", "trad")(lambda t: F.when(c("market_cap") > 0, F.log(c("market_cap"))))
_feature("max_5", "trad")(lambda t: t.max("_r1", 5))
_feature("skew_20", "trad")(lambda t: ratio(t.mean(t.dev3("_r1", 20), 20),
                                            _cube(t.std("_r1", 20)) + 1e-12))
_feature("bias_20", "trad")(lambda t: ratio(c("adj_close"), t.mean("adj_close", 20)) - 1)
_feature("hl_range_20", "trad")(lambda t: t.mean("_hl", 20))

_feature("a101_001", "a101")(lambda t: ratio(c("close") - c("open"), c("high") - c("low") + 0.001))
_feature("a101_006", "a101")(lambda t: -t.corr("open", "volume", 10))
_feature("a101_012", "a101")(lambda t: sign(c("volume") - t.lag(c("volume")))
                             * (_back(t, 1) - c("adj_close")))
_feature("a101_041", "a101")(lambda t: F.sqrt(c("high") * c("low")) - c("vwap"))
_feature("a101_053", "a101")(lambda t: t.lag(c("_pos_low"), 9) - c("_pos_low"))
_feature("a101_054", "a101")(lambda t: -ratio(
    (c("low") - c("close")) * _fifth(c("open")),
    (c("low") - c("high")) * _fifth(c("close")) + 1e-12))
_feature("a101_004", "a101")(lambda t: -t.below("_rank_low", 9) / F.lit(9.0))

_feature("a191_001", "a191")(lambda t: -t.corr("_rank_dlogv", "_rank_drive", 6))
_feature("a191_002", "a191")(lambda t: t.lag(c("_pos_range"), 1) - c("_pos_range"))
_feature("a191_014", "a191")(lambda t: c("adj_close") - _back(t, 5))
_feature("a191_018", "a191")(lambda t: ratio(c("adj_close"), _back(t, 5)))
_feature("a191_020", "a191")(lambda t: ratio(c("adj_close") - c("_c6"), c("_c6") + 1e-12) * 100)
_feature("a191_053", "a191")(lambda t: t.sum("_up", 12) / 12 * 100)

_feature("q158_kmid", "q158")(lambda t: ratio(c("close") - c("open"), c("open")))
_feature("q158_klen", "q158")(lambda t: ratio(c("high") - c("low"), c("open")))
_feature("q158_kup", "q158")(lambda t: ratio(c("high") - F.greatest("open", "close"), c("open")))
_feature("q158_rsv_20", "q158")(lambda t: ratio(
    c("close") - t.min("low", 20), t.max("high", 20) - t.min("low", 20) + 1e-12))
_feature("q158_roc_10", "q158")(lambda t: _ret(t, 10))
_feature("q158_std_60", "q158")(lambda t: t.std("_r1", 60))
_feature("q158_vsty_20", "q158")(lambda t: ratio(t.std("volume", 20),
                                                 t.mean("volume", 20) + 1))
_feature("q158_cntp_20", "q158")(lambda t: t.mean("_up", 20))
_feature("q158_corr_pv_20", "q158")(lambda t: t.corr("adj_close", "log_volume", 20))

FEATURES = tuple(_FEATURES)
FAMILY = {name: family for name, (family, _) in _FEATURES.items()}


def _rank01(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average rank within ``ts`` scaled to [0, 1] by the size of the cross-section."""
    df = with_rank(df, [TS], column, "_rk")
    df = over_group(df, [TS], {"_n": F.count(F.lit(1))})
    return df.withColumn(out, (c("_rk") - 1) / F.greatest(c("_n") - 1, F.lit(1))).drop("_rk", "_n")


_RANK_INPUTS = {"a101_004": ["_rank_low"], "a191_001": ["_rank_dlogv", "_rank_drive"]}


#: Formulas that read ranks, and nothing else.
RANKED = tuple(_RANK_INPUTS)


def compute_features(bars: DataFrame, names: Sequence[str] | None = None, *,
                     keep: Sequence[str] = (), written_ranks: bool = False) -> DataFrame:
    """``(ts, symbol, <features>)``; leading rows are NULL while windows fill.  Columns in ``keep`` are passed on.

    ``written_ranks`` writes the ranks that formulas of ``RANKED`` read, so that what they took to make is off the disks
    before rows are brought to their symbol again; only such formulas may be asked for then.
    """
    wanted = list(names) if names is not None else list(FEATURES)
    unknown = [n for n in wanted if n not in _FEATURES]
    if unknown:
        raise KeyError(f"unknown feature(s) {unknown}")
    require_columns(bars, (TS, SYMBOL, *REQUIRED, *keep), "compute_features")
    ranks = {r for n in wanted for r in _RANK_INPUTS.get(n, ())}
    df = bars.select(TS, SYMBOL, *dict.fromkeys([*REQUIRED, *keep]))
    if "_rank_dlogv" in ranks:
        df = with_trailing(df, [SYMBOL], [TS], 1, lambda d, t: d.withColumn(
            "_dlogv", c("log_volume") - t.lag(c("log_volume"))))
        df = df.withColumn("_drive", ratio(c("close") - c("open"), c("open")))
        df = _rank01(df, "_dlogv", "_rank_dlogv")
        df = _rank01(df, "_drive", "_rank_drive")
    if "_rank_low" in ranks:
        df = _rank01(df, "low", "_rank_low")
    if written_ranks:
        if not set(wanted) <= set(RANKED):
            raise ValueError(f"formulas that read more than ranks: {sorted(set(wanted) - set(RANKED))}")
        df = durable(df.select(TS, SYMBOL, *keep, *sorted(ranks)))
        df = df.withColumns({n: F.lit(None).cast("double") for n in REQUIRED})

    def build(d: DataFrame, trail: Trail) -> DataFrame:
        extra = [k for k in d.columns if k in ("_halo", "_slice")]
        d = d.withColumn("_r1", _ret(trail, 1))
        d = d.withColumns({
            "_c6": _back(trail, 6), "_excess": c("_r1") - c("mkt_ret"),
            "_impact": ratio(F.abs(c("_r1")), c("amount") + 1), "_hl": ratio(c("high") - c("low"), c("close")),
            "_up": F.when(c("_r1").isNotNull(), (c("_r1") > 0).cast("double")),
            "_pos_low": ratio(_body(), c("close") - c("low") + 1e-6),
            "_pos_range": ratio(_body(), c("high") - c("low") + 1e-6),
        })
        plain, late, t = {}, {}, _Formulas(trail)
        for n in wanted:
            asked = t.asked
            expr = _FEATURES[n][1](t)
            (late if t.asked > asked else plain)[f"_f_{n}"] = expr
        # materialised before the finiteness test, which mentions its argument several times
        d = d.withColumns(plain)
        if t.specs:
            used = {x for spec in t.specs.values() for x in spec[1:] if isinstance(x, str)}
            d = d.select(TS, SYMBOL, *dict.fromkeys([*extra, *keep, "close", "adj_close", *sorted(used - set(t.specs)), *plain]))
            d = trail.stats(d, t.specs).withColumns(late)
        return d.withColumns({n: finite(c(f"_f_{n}")) for n in wanted})

    # nested windows (a mean of deviations from a mean) look back twice as far
    return with_trailing(df, [SYMBOL], [TS], REACH, build).select(TS, SYMBOL, *keep, *wanted)
