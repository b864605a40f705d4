"""Joins of points with the intervals that hold them, with or without an equality key.

An equi-join on a symbol with the dates as a residual compares every point of the symbol with every spell of it, and
without a symbol there is no equi-join at all. Here the line is cut at quantiles of the points into a power of two of
leaves, the leaves of a binary tree. An interval goes to the few nodes that make up the leaves inside it and to the
two leaves it ends in, a point to the nodes above its leaf. Each pair meets in exactly one node, so an equi-join on
the node gives every pair once, and only pairs in end leaves can fail the comparison that follows. Both sides grow
by a factor of about the tree's height, whatever the intervals' lengths are.

Nodes whose pairs are more than a task should write are dealt: points by their row's number, intervals to every part.
Quantiles and counts steer the plan only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..functions.ordered import annotate, durable, with_running, with_trailing

#: Points that a leaf should hold, and most leaves.
LEAF_POINTS, MAX_LEAVES = 20_000, 2048
#: Pairs that one task should write.
PAIRS = 50_000_000
#: Up to so many intervals of one key the plain join on the key compares few pairs in vain.
FEW = 32


def holds(point: Column, start: Column, end: Column) -> Column:
    """``start <= point < end``; an open end is NULL."""
    return (point >= start) & (end.isNull() | (point < end))


def _number(x: Column, kind: str) -> Column:
    """A double that does not fall where ``x`` rises."""
    if kind == "date":
        return F.unix_date(x).cast("double")
    if kind == "timestamp_ntz":
        day = F.unix_date(F.to_date(x)).cast("double") * 86400.0
        return day + F.hour(x) * 3600.0 + F.minute(x) * 60.0 + F.second(x).cast("double")
    return x.cast("double")


def cuts(points: DataFrame, point: str, leaves: int) -> list[float]:
    """``leaves - 1`` ascending numbers that part the points about evenly; repeats are moved to the end as infinity."""
    x = points.select(_number(F.col(point), points.schema[point].dataType.simpleString()).alias("x"))
    found = sorted(set(x.approxQuantile("x", [i / leaves for i in range(1, leaves)], 0.25 / leaves))) if leaves > 1 else []
    return [*found, *[float("inf")] * (leaves - 1 - len(found))]


def _leaf(x: Column, bounds: Sequence[float]) -> Column:
    """How many of the bounds are not above ``x``, by binary search; NULL stays NULL."""
    height = (len(bounds) + 1).bit_length() - 1
    if not height:
        return F.when(x.isNotNull(), 0)
    array = F.array(*[F.lit(float(b)) for b in bounds])
    steps = F.array(*[F.lit(1 << (height - 1 - i)) for i in range(height)])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(array, at + s - 1) <= x, at + s).otherwise(at))
    return F.when(x.isNotNull(), found)


def _above(leaf: Column, height: int) -> Column:
    """The nodes from a leaf to the root: the root is 1, the children of ``k`` are ``2k`` and ``2k + 1``."""
    at = leaf + (1 << height)
    return F.array(*[F.shiftright(at, i) for i in range(height + 1)])


def _cover(first: Column, last: Column, height: int) -> Column:
    """The nodes that make up the leaves between ``first`` and ``last``, and these two leaves (the last may be past the end)."""
    leaves = 1 << height
    out = [first + leaves, F.when((last > first) & (last < leaves), last + leaves)]
    low, high = first + 1 + leaves, last + leaves
    for i in range(height + 1):
        a, b = F.shiftright(low + ((1 << i) - 1), i), F.shiftright(high, i)
        out += [F.when((a < b) & (a % 2 == 1), a), F.when((a < b) & (b % 2 == 1), b - 1)]
    return F.array_compact(F.array(*out))


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, by: Sequence[str] = (), *,
                  leaves: int | None = None, pairs: int = PAIRS) -> DataFrame:
    """Every row of ``points`` beside every row of ``intervals`` with ``start <= point < end`` and equal ``by``.

    An open end is NULL. A NULL point, start or key meets nothing, nor does an interval that ends before it starts.
    Repeated rows give repeated pairs. Besides ``by`` the two sides may not share a column.
    """
    require_columns(points, (point, *by), "interval_join points")
    require_columns(intervals, (start, end, *by), "interval_join intervals")
    if both := (set(points.columns) & set(intervals.columns)) - set(by):
        raise ValueError(f"both sides have columns {sorted(both)}")
    names = [*points.columns, *[c for c in intervals.columns if c not in by]]
    match = holds(F.col(point), F.col(start), F.col(end))
    sound = intervals.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    if by and leaves is None:
        most = sound.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if most <= FEW:
            return points.join(sound, list(by)).where(match).select(*names)
    if leaves is None:
        leaves = min(MAX_LEAVES, 1 << max(0, -(-points.count() // LEAF_POINTS) - 1).bit_length())
    height = leaves.bit_length() - 1
    bounds = cuts(points, point, leaves)

    def leaf(df: DataFrame, c: str) -> Column:
        return _leaf(_number(F.col(c), df.schema[c].dataType.simpleString()), bounds)

    p = points.where(F.col(point).isNotNull()).withColumn("_iv_node", F.explode(_above(leaf(points, point), height)))
    s = sound.withColumns({"_iv_a": leaf(sound, start), "_iv_b": F.coalesce(leaf(sound, end), F.lit(leaves))})
    s = s.withColumn("_iv_node", F.explode(_cover(F.col("_iv_a"), F.col("_iv_b"), height))).drop("_iv_a", "_iv_b")
    key = [*by, "_iv_node"]
    counts = p.groupBy(*key).agg(F.count(F.lit(1)).alias("_iv_p")).join(s.groupBy(*key).agg(F.count(F.lit(1)).alias("_iv_s")), key)
    hot = durable(counts.where(F.col("_iv_p").cast("double") * F.col("_iv_s") > pairs).select(
        *key, F.ceil(F.col("_iv_p").cast("double") * F.col("_iv_s") / pairs).cast("int").alias("_iv_parts")))
    if hot.isEmpty():
        return p.join(s, key).where(match).select(*names)
    # dealt by a number that is written with the row, so that a task run again deals alike
    p = durable(p.withColumn("_iv_row", F.monotonically_increasing_id()))
    p = p.join(hot, key, "left").withColumn("_iv_part", F.coalesce(F.col("_iv_row") % F.col("_iv_parts"), F.lit(0)).cast("int")).drop("_iv_parts")
    s = s.join(hot, key, "left").withColumn("_iv_part", F.explode(F.sequence(F.lit(0), F.coalesce("_iv_parts", F.lit(1)) - 1))).drop("_iv_parts")
    return p.join(s, [*key, "_iv_part"]).where(match).select(*names)


def merged(intervals: DataFrame, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``start`` and ``end`` of the union of each key's intervals; those that touch are one."""
    whole = [F.lit(0).alias("_iv_key")] if not by else [F.col(b) for b in by]
    keys = list(by) or ["_iv_key"]
    t = intervals.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    t = t.groupBy(*whole, F.col(start)).agg(F.max(F.col(end).isNull()).alias("_iv_open"), F.max(end).alias("_iv_end"))
    rank = F.struct("_iv_open", "_iv_end")  # an open end is the latest
    t = with_running(t, keys, [start], {"_iv_top": ("max", rank)})
    t = with_trailing(t, keys, [start], 2, lambda d, w: d.withColumn("_iv_before", w.lag(F.col("_iv_top"))))
    gap = F.when(F.col("_iv_before").isNull() | (~F.col("_iv_before._iv_open") & (F.col(start) > F.col("_iv_before._iv_end"))), 1.0).otherwise(0.0)
    t = with_running(t, keys, [start], {"_iv_n": ("sum", gap)})
    out = t.groupBy(*keys, "_iv_n").agg(F.min(start).alias(start), F.max("_iv_open").alias("_iv_open"), F.max("_iv_end").alias("_iv_end"))
    return out.select(*by, start, F.when(~F.col("_iv_open"), F.col("_iv_end")).alias(end))


def open_counts(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """``point, n_open, n_keys``: how many intervals, and how many different ``keys`` of them, hold each different point.

    No pair is written: a count rises at a start and falls at an end, and the intervals of a key are merged first to count
    keys. Points that no interval holds do not come out; an open end is NULL.
    """
    sound = intervals.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    ends = {"n_open": sound, "n_keys": merged(sound.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))),
                                              start, end, keys)}
    parts = [points.select(F.col(point).alias("_iv_at")).where(F.col("_iv_at").isNotNull()).distinct().select(
        "_iv_at", F.lit(True).alias("_iv_is"), F.lit(0).cast("long").alias("n_open"), F.lit(0).cast("long").alias("n_keys"))]
    for name, t in ends.items():
        for side, sign in ((start, 1), (end, -1)):
            n = t.where(F.col(side).isNotNull()).groupBy(F.col(side).alias("_iv_at")).agg((sign * F.count(F.lit(1))).alias("_iv_d"))
            parts.append(n.select("_iv_at", F.lit(False), *[F.col("_iv_d") if c == name else F.lit(0).cast("long") for c in ends]))
    steps = durable(reduce(DataFrame.unionAll, parts).groupBy("_iv_at").agg(
        F.max("_iv_is").alias("_iv_is"), *[F.sum(c).alias(f"_iv_{c}") for c in ends]).withColumn("_iv_all", F.lit(0)))
    steps = annotate(steps, {"_iv_all": (steps.count(), 1)})
    out = with_running(steps, ["_iv_all"], ["_iv_at"], {c: ("sum", F.col(f"_iv_{c}")) for c in ends})
    return out.where(F.col("_iv_is") & (F.col("n_open") > 0)).select(F.col("_iv_at").alias(point), *ends)


def _exact(x: Column, kind: str) -> Column:
    """A number that rises strictly where ``x`` does."""
    if kind == "date":
        return F.unix_date(x).cast("long")
    if kind == "timestamp":
        return F.unix_micros(x)
    if kind == "timestamp_ntz":
        seconds = (F.unix_date(F.to_date(x)).cast("long") * 24 + F.hour(x)) * 3600 + F.minute(x) * 60
        return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), x) * 1_000_000).cast("long")
    return x


def open_intervals(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, by: Sequence[str], *,
                   oldest: str = "oldest") -> DataFrame:
    """The rows of ``points`` that intervals of their key hold, with ``n_open``, their number, and their earliest start.

    No pair is written. The number rises at a start and falls at an end. The earliest start of the intervals that end after
    a point is a running minimum from the last end back; where any of these holds the point, the earliest does.
    """
    kind = points.schema[point].dataType.simpleString()
    if {intervals.schema[c].dataType.simpleString() for c in (start, end)} != {kind}:
        raise ValueError(f"{point}, {start} and {end} differ in type")
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by])
    sound = intervals.where(keyed & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    none = F.lit(None).cast(kind)
    sides = sound.select(*by, F.explode(F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("d"), none.alias("s")),
        F.struct(F.col(end).alias("at"), F.when(F.col(end).isNull(), 0).otherwise(-1).alias("d"), F.col(start).alias("s")))).alias("_iv"))
    changes = sides.groupBy(*by, F.col("_iv.at").alias("_iv_x")).agg(F.sum("_iv.d").alias("_iv_d"), F.min("_iv.s").alias("_iv_s"))
    row = F.struct(*points.columns)
    t = changes.select(*by, "_iv_x", F.lit(0).alias("_iv_is"), "_iv_d", "_iv_s", F.lit(None).cast(points.select(row).schema[0].dataType).alias("_iv_row"))
    t = durable(t.unionAll(points.where(keyed & F.col(point).isNotNull()).select(
        *by, F.col(point), F.lit(1), F.lit(0).cast("long"), none, row)))
    most = t.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    at, old = _exact(F.col("_iv_x"), kind), _exact(F.col("_iv_s"), kind)
    t = t.withColumns({"_iv_at": at, "_iv_back": -at, "_iv_last": 1 - F.col("_iv_is"), "_iv_old": F.when(old.isNotNull(), F.struct(-old, "_iv_s"))})
    t = annotate(t, {k: (most, 0) for k in by})
    t = with_running(t, by, ["_iv_at", "_iv_is"], {"n_open": ("sum", F.col("_iv_d"))})
    # from the last end back; a point stands before the ends at its own place, which do not hold it, and after open ends
    t = with_running(t, by, ["_iv_back", "_iv_last"], {"_iv_first": ("max", F.col("_iv_old"))})
    return t.where((F.col("_iv_is") == 1) & (F.col("n_open") > 0)).select("_iv_row.*", "n_open", F.col("_iv_first._iv_s").alias(oldest))


def covered(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, by: Sequence[str] = (), **options) -> DataFrame:
    """The rows of ``points`` that at least one interval of their key holds, each once."""
    spans = merged(intervals, start, end, by).withColumnsRenamed({start: "_iv_start", end: "_iv_stop"})
    return interval_join(points, spans, point, "_iv_start", "_iv_stop", by, **options).select(*points.columns)
