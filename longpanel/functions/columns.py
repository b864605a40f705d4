"""Column-level helpers shared by every operator.

Spark 4 runs with ANSI arithmetic, so a plain ``/`` raises on a zero divisor.  All ratios go
through :func:`ratio`, which gives NULL, and every statistic that may be undefined is NULL too:
Spark orders NaN above every number and treats NaN as equal to itself, so NaN never enters a
panel.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TS = "ts"
SYMBOL = "symbol"
KEYS = (TS, SYMBOL)


def require_columns(df: DataFrame, names: Iterable[str], where: str) -> None:
    """Raise ``KeyError`` at plan time when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"{where}: column(s) {missing} not in frame; have {df.columns}")


def as_list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def ratio(a, b) -> Column:
    """``a / b`` in double precision, NULL when ``b`` is zero or either side is NULL."""
    return F.try_divide(num(a).cast("double"), num(b).cast("double"))


def at_least(x: Column, low) -> Column:
    """Clip from below.  ``greatest`` skips NULL, so NULL is kept explicitly."""
    return F.when(x.isNotNull(), F.greatest(x.cast("double"), F.lit(float(low))))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def finite(x: Column) -> Column:
    """NULL for NaN and for both infinities."""
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(x) & (x < inf) & (x > -inf), x)


def is_finite(x: Column) -> Column:
    """TRUE for a real number, FALSE for NULL, NaN and infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def clean_non_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite values become NULL in every listed column."""
    require_columns(df, columns, "clean_non_finite")
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})


def sign(x: Column) -> Column:
    return F.when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0)


def pos_zero(x: Column) -> Column:
    """Turns -0.0 into 0.0."""
    return x + F.lit(0.0)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str],
            name: str = "factor", value: str = "value") -> DataFrame:
    """Wide to long with one narrow row per (ids, column); NULL values are kept."""
    require_columns(df, [*ids, *columns], "unpivot")
    return df.select(
        *ids,
        F.explode(F.array(*[
            F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns
        ])).alias("_kv"),
    ).select(*ids, f"_kv.{name}", f"_kv.{value}")


def sample_corr_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column,
                          sxy: Column, floor: float = 1e-12) -> Column:
    """Pearson correlation from power sums, NULL when either side has no dispersion.

    ``floor`` is relative: a constant side leaves rounding dust in ``n*sxx - sx*sx``.
    """
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    ok = (vx > F.lit(floor) * n * sxx) & (vy > F.lit(floor) * n * syy)
    return F.when(ok, ratio(n * sxy - sx * sy, F.sqrt(vx) * F.sqrt(vy)))
