"""Point-in-time universes: dates and panel rows held against spells by interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UniverseError
from ..functions.columns import SYMBOL, TS, require_columns
from .intervals import covered, holds, interval_join


def _check_membership(m: DataFrame) -> DataFrame:
    """Dates as DATE; a missing start is refused when the plan runs."""
    require_columns(m, ("index_code", SYMBOL, "start_date", "end_date"), "membership")
    start = F.col("start_date").cast("date")
    return m.select(
        "index_code", SYMBOL,
        F.when(start.isNotNull(), start).otherwise(F.raise_error(F.lit(
            "membership has a null start_date and cannot be resolved point-in-time"))
        ).cast("date").alias("start_date"),
        F.col("end_date").cast("date").alias("end_date"))


def members_at(membership: DataFrame, day: str) -> DataFrame:
    """Membership rows in effect on one day: ``start <= day < end``."""
    m = _check_membership(membership)
    return m.where(holds(F.lit(day).cast("date"), F.col("start_date"), F.col("end_date")))


def members_over(dates: DataFrame, membership: DataFrame, date: str = "date") -> DataFrame:
    """``(date, index_code, symbol, start_date, end_date)``: the membership in effect on each of many dates.

    There is no key to join on; the work follows the result, not dates times spells.
    """
    require_columns(dates, (date,), "dates")
    days = dates.select(F.col(date).cast("date").alias(date))
    return interval_join(days, _check_membership(membership), date, "start_date", "end_date")


def membership_panel(df: DataFrame, membership: DataFrame) -> DataFrame:
    """``(ts, symbol, index_code)`` for every panel row and every index it belongs to at ``ts``."""
    days = df.select(TS, SYMBOL, F.to_date(F.col(TS)).alias("_day"))
    return interval_join(days, _check_membership(membership), "_day", "start_date", "end_date", [SYMBOL]).select(
        TS, SYMBOL, "index_code")


def _inside(df: DataFrame, spells: DataFrame, start: str, end: str) -> DataFrame:
    """Panel rows whose day lies in a spell of their symbol, each once."""
    days = df.withColumn("_day", F.to_date(F.col(TS)))
    return covered(days, spells, "_day", start, end, [SYMBOL]).select(*df.columns)


def listed(df: DataFrame, listings: DataFrame) -> DataFrame:
    """Panel rows of names listed and not yet delisted at ``ts``."""
    require_columns(listings, (SYMBOL, "list_date"), "listings")
    end = F.col("delist_date") if "delist_date" in listings.columns else F.lit(None)
    spells = listings.select(SYMBOL, F.col("list_date").cast("date").alias("_from"), end.cast("date").alias("_to"))
    return _inside(df, spells, "_from", "_to")


def universe(df: DataFrame, rule: str = "all", *, membership: DataFrame | None = None,
             listings: DataFrame | None = None) -> DataFrame:
    """Panel rows inside the universe at their own ``ts``.

    ``all`` keeps listed names; any other rule is an index code, intersected with listed names
    when listings are given.
    """
    if rule == "all":
        if listings is None:
            raise UniverseError("rule 'all' needs a listings table: without one it would mean "
                                "every symbol the file happens to contain")
        return listed(df, listings)
    if membership is None:
        raise UniverseError(f"rule {rule!r} needs a membership table with effective dates")
    m = _check_membership(membership).where(F.col("index_code") == rule)
    out = _inside(df, m.select(SYMBOL, F.col("start_date").alias("_from"), F.col("end_date").alias("_to")), "_from", "_to")
    return out if listings is None else listed(out, listings)


def universe_at(day: str, rule: str = "all", *, membership: DataFrame | None = None,
                listings: DataFrame | None = None) -> DataFrame:
    """Symbols of the universe on one day; an index without constituents that day is an error."""
    d = F.lit(day).cast("date")
    names = None
    if listings is not None:
        end = (F.col("delist_date").cast("date") if "delist_date" in listings.columns
               else F.lit(None).cast("date"))
        names = listings.where(holds(d, F.col("list_date").cast("date"), end)).select(
            SYMBOL).distinct()
    if rule == "all":
        if names is None:
            raise UniverseError("rule 'all' needs a listings table")
        return names
    if membership is None:
        raise UniverseError(f"rule {rule!r} needs a membership table with effective dates")
    members = members_at(membership, day).where(F.col("index_code") == rule).select(
        SYMBOL).distinct()
    if members.limit(1).count() == 0:
        raise UniverseError(f"no constituents for index {rule!r} on {day}")
    return members if names is None else members.join(names, SYMBOL, "left_semi")


def liquid_names(df: DataFrame, top: int, *, prefixes: Sequence[str] | None = None,
                 amount: str = "amount", trades: str = "n_trades") -> DataFrame:
    """The ``top`` symbols by total amount among those that traded; ties go by symbol."""
    d = df
    if prefixes is not None:
        d = d.where(F.substring(SYMBOL, 1, 2).isin(list(prefixes)))
    totals = d.groupBy(SYMBOL).agg(F.sum(amount).alias("amt"), F.sum(trades).alias("nt"))
    return totals.where(F.col("nt") > 0).orderBy(F.desc("amt"), SYMBOL).limit(top).select(
        SYMBOL, "amt", "nt")


def keep_liquid(df: DataFrame, top: int, **kw) -> DataFrame:
    """Rows of the ``top`` most liquid symbols."""
    return df.join(liquid_names(df, top, **kw).select(SYMBOL), SYMBOL, "left_semi")
