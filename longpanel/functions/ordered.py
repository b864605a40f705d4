"""Group-wise primitives that keep working when one group holds a large share of the rows.

A window function brings a whole group into one task.  That is the best plan while groups are
small, and it fails when a single timestamp or symbol carries a third of the table.  Every
operator therefore goes through this module, which knows (or measures, once) an upper bound of
rows per group and picks one of two exact plans:

* bound within ``spark.longpanel.maxGroupRows``: plain window functions, one Exchange;
* bound above it: partial aggregates joined back, or a range-partitioned position table whose
  slices are of equal size whatever the group sizes are.

The bound travels in column metadata, so it is measured on the input panel and then inherited
by every derived frame.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_KEY = "longpanel.max_rows"
GROUPS_KEY = "longpanel.n_groups"
LIMIT_CONF = "spark.longpanel.maxGroupRows"
DEFAULT_LIMIT = 4_000_000
# Up to so many distinct values, a table of them goes to the rows instead of the rows to it.
BROADCAST_VALUES = 100_000
# The same for statistics of groups, whose rows are wider.
FEW_GROUPS = 10_000
# A task that holds a group as numbers only may hold as many of them for each row that the limit allows.
CELLS_A_ROW = 4
# Shuffle files go when the job that wrote them is over, not when the driver happens to collect its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UNB = W.unboundedPreceding


# ------------------------------------------------------------------ durability


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names; a temporary one only in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-")


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What jobs shuffle within leaves the disks as soon as they are over."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)


def _store(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = shared_dir(spark, "stage")
    with released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Lineage ends there, so lost executors cannot change what was computed; unlike an RDD
    checkpoint the table keeps column pruning and real sizes for the joins that follow.  What was
    shuffled for it leaves the disks as soon as it is written.
    """
    return _store(df)[0]


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """A :func:`durable` table for jobs that end within; it is deleted after them."""
    table, path = _store(df)
    try:
        yield table
    finally:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


# ------------------------------------------------------------------ group bounds


def group_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(LIMIT_CONF, str(DEFAULT_LIMIT)))


def annotate(df: DataFrame, bounds: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Attach ``column -> (max rows per value, number of values)`` as column metadata."""
    for name, (rows, groups) in bounds.items():
        meta = dict(df.schema[name].metadata or {})
        meta.update({ROWS_KEY: int(rows), GROUPS_KEY: int(groups)})
        df = df.withMetadata(name, meta)
    return df


def measured_bounds(df: DataFrame, *keys: str) -> dict[str, tuple[int, int]]:
    """One job: the largest group and the number of groups for each key."""
    parts = [
        df.groupBy(k).count().agg(F.max("count").alias("m"), F.count(F.lit(1)).alias("n"))
        .select(F.lit(k).alias("k"), "m", "n")
        for k in keys
    ]
    rows = reduce(DataFrame.unionAll, parts).collect()
    return {r["k"]: (int(r["m"] or 0), int(r["n"])) for r in rows}


def measure(df: DataFrame, *keys: str) -> DataFrame:
    return annotate(df, measured_bounds(df, *keys))


def _meta(df: DataFrame, name: str, key: str) -> int | None:
    return (df.schema[name].metadata or {}).get(key)


def row_bound(df: DataFrame, by: Sequence[str]) -> int:
    """Upper bound of rows in one ``by`` group; measured when no bound was inherited."""
    known = [b for b in (_meta(df, k, ROWS_KEY) for k in by) if b is not None]
    if known:
        return min(known)
    if not by:
        return df.count()
    top = df.groupBy(*by).count().agg(F.max("count")).first()[0]
    return int(top or 0)


def is_hot(df: DataFrame, by: Sequence[str]) -> bool:
    return row_bound(df, by) > group_limit(df.sparkSession)


def value_count(df: DataFrame, name: str) -> int:
    """Number of distinct values of a key column, counted from the frame itself."""
    return df.select(name).where(F.col(name).isNotNull()).distinct().count()


def value_bound(df: DataFrame, name: str) -> int:
    """About how many distinct values a key column has: inherited, or counted.

    It only steers plans.  Filters, unions and joins change the true number, so nothing that
    enters a result may be taken from here.
    """
    known = _meta(df, name, GROUPS_KEY)
    return int(known) if known is not None else value_count(df, name)


# ------------------------------------------------------------------ joins on group keys


def join_back(df: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-group columns back.  ``right`` has one row per group.  It is broadcast where groups are known to be few, so that
    the rows stay where they are; else AQE broadcasts it when its measured size allows, after the rows were shuffled, and splits
    skewed left partitions otherwise.  NULL keys are one group."""
    if not by:
        return df.join(right, [], how)
    if len(by) == 1 and how == "left" and 0 < (_meta(df, by[0], GROUPS_KEY) or 0) <= FEW_GROUPS:
        right = F.broadcast(right)
    named = right.withColumnsRenamed({k: f"_by_{k}" for k in by})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by])
    return df.join(named, same, how).drop(*[f"_by_{k}" for k in by])


def over_group(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Add group aggregates to every row."""
    if is_hot(df, by):
        stats = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
        return join_back(df.drop(*aggs), stats, by)
    w = W.partitionBy(*by)
    return df.withColumns({n: a.over(w) for n, a in aggs.items()})


# ------------------------------------------------------------------ position table


def _positions(df: DataFrame, by: Sequence[str], order: Sequence[str], nulls: bool = False) -> DataFrame:
    """``(by, order, _c, _below)``: multiplicity of each distinct key and rows before it.

    Keys with a NULL in ``order`` come first if ``nulls``, else they have no position.

    Built without bringing a group into one task: distinct keys are range partitioned, slice
    totals are turned into offsets, and only slices are scanned in order.  The slice id is
    written to reliable storage first, because it is not reproducible across recomputation.
    """
    spark = df.sparkSession
    slices = max(
        int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
        2 * -(-row_bound(df, by) // group_limit(spark)),
    )
    keys = [*by, *order]
    if not nulls:
        df = df.where(reduce(lambda a, b: a & b, [F.col(o).isNotNull() for o in order]))
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    d = d.repartitionByRange(slices, *keys).withColumn("_p", F.spark_partition_id())
    d = durable(d)
    before = W.partitionBy(*by).orderBy("_p").rowsBetween(UNB, -1)
    offsets = (
        d.groupBy("_p", *by).agg(F.sum("_c").alias("_s"))
        .withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0)))
        .drop("_s")
    )
    inner = W.partitionBy("_p", *by).orderBy(*order).rowsBetween(UNB, -1)
    return (
        join_back(d, offsets, ["_p", *by])
        .withColumn("_below", F.col("_o") + F.coalesce(F.sum("_c").over(inner), F.lit(0)))
        .drop("_p", "_o")
    )


# ------------------------------------------------------------------ ranks


def with_rank(df: DataFrame, by: Sequence[str], value: str, out: str,
              kind: str = "average", ties: Sequence[str] = ()) -> DataFrame:
    """Rank ``value`` within each group, 1-based; NULL values get a NULL rank.

    ``average`` shares ranks between equal values, ``ordinal`` breaks ties by ``ties``.
    """
    if kind not in ("average", "ordinal"):
        raise ValueError(f"unknown rank kind {kind!r}")
    v = F.col(value)
    if not is_hot(df, by):
        if kind == "average":
            # ties are the peers of a row in the same order, so rank and ties share one sort
            w = W.partitionBy(*by).orderBy(v.asc_nulls_last())
            ties_of = F.count(F.lit(1)).over(w.rangeBetween(W.currentRow, W.currentRow))
            expr = F.rank().over(w) + (ties_of - 1) / F.lit(2.0)
        else:
            expr = F.row_number().over(
                W.partitionBy(*by).orderBy(v.asc_nulls_last(), *ties)).cast("bigint")
        return df.withColumn(out, F.when(v.isNotNull(), expr))
    df = df.drop(out)
    if kind == "average":
        rank = F.col("_below") + (F.col("_c") + 1) / F.lit(2.0)
        return join_back(df, _positions(df, by, [value]).select(*by, value, rank.alias(out)), [*by, value])
    # a struct keeps NULL ties in order and equal rows together; those are numbered among themselves
    df = df.withColumn("_tie", F.struct(*ties) if ties else F.lit(0))
    table = _positions(df, by, [value, "_tie"]).select(*by, value, "_tie", "_below")
    df = join_back(df, table, [*by, value, "_tie"])
    among = F.row_number().over(W.partitionBy(*by, value, "_tie").orderBy(F.lit(0)))
    return df.withColumn(out, F.when(v.isNotNull(), F.col("_below") + among).cast("bigint")).drop("_tie", "_below")


# ------------------------------------------------------------------ quantiles


def group_quantiles(df: DataFrame, by: Sequence[str], value: str,
                    quantiles: Mapping[str, float], interpolation: str = "linear") -> DataFrame:
    """One row per group with exact quantiles of the non-null values.

    ``linear`` interpolates between order statistics; ``lower`` and ``nearest`` return one.
    """
    if interpolation not in ("linear", "lower", "nearest"):
        raise ValueError(f"unknown interpolation {interpolation!r}")
    if interpolation == "linear" and not is_hot(df, by):
        return df.groupBy(*by).agg(
            *[F.percentile(value, F.lit(q)).alias(n) for n, q in quantiles.items()])
    if is_hot(df, by):
        pos = _positions(df, by, [value])
        pos = join_back(pos, pos.groupBy(*by).agg(F.sum("_c").alias("_n")), by)
    else:
        w = W.partitionBy(*by)
        pos = df.where(F.col(value).isNotNull()).select(
            *by, value, F.lit(1).alias("_c"),
            (F.row_number().over(w.orderBy(value)) - 1).cast("bigint").alias("_below"),
            F.count(F.lit(1)).over(w).alias("_n"))

    def holds(k: Column) -> Column:
        return (F.col("_below") <= k) & (k < F.col("_below") + F.col("_c"))

    aggs = []
    for n, q in quantiles.items():
        target = F.lit(float(q)) * (F.col("_n") - 1)
        lo, hi = F.floor(target), F.ceil(target)
        if interpolation == "nearest":
            lo = hi = F.floor(target + 0.5)
        elif interpolation == "lower":
            hi = lo
        aggs += [F.max(F.when(holds(lo), F.col(value))).alias(f"_lo_{n}"),
                 F.max(F.when(holds(hi), F.col(value))).alias(f"_hi_{n}"),
                 F.max(target - lo).alias(f"_w_{n}")]
    picked = pos.groupBy(*by).agg(*aggs)
    outs = []
    for n in quantiles:
        lo, hi, wgt = F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), F.col(f"_w_{n}")
        outs.append((lo + (hi - lo) * wgt if interpolation == "linear" else lo).alias(n))
    # a group without values is a row of NULLs in every plan
    return join_back(df.select(*by).distinct(), picked.select(*by, *outs), by) if by else picked.select(*outs)


def with_quantiles(df: DataFrame, by: Sequence[str], value: str,
                   quantiles: Mapping[str, float], interpolation: str = "linear") -> DataFrame:
    """Attach group quantiles to every row."""
    if interpolation == "linear" and not is_hot(df, by):
        w = W.partitionBy(*by)
        return df.withColumns(
            {n: F.percentile(value, F.lit(q)).over(w) for n, q in quantiles.items()})
    return join_back(df, group_quantiles(df, by, value, quantiles, interpolation), by)


# ------------------------------------------------------------------ trailing windows


class Trail:
    """Trailing expressions within one key, in one order; the window ends at the current row."""

    def __init__(self, keys: Sequence[str], order: Sequence[str]):
        self.keys = list(keys)
        self.order = list(order)

    def window(self, n: int | None = None):
        w = W.partitionBy(*self.keys).orderBy(*self.order)
        return w if n is None else w.rowsBetween(-(n - 1), 0)

    def stats(self, df: DataFrame, specs: Mapping[str, tuple]) -> DataFrame:
        """Add trailing statistics of many windows in one pass: ``out -> (kind, column[, column], n)``.

        See :mod:`functions.trailing`.  A window function goes over its whole frame again for every row and every
        aggregate, which is what long windows cost.
        """
        from .trailing import trailing_stats

        return trailing_stats(df.withColumn("_row", F.row_number().over(self.window())), "_row", specs).drop("_row")

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.window())

    def lead(self, x: Column, n: int = 1) -> Column:
        return F.lead(x, n).over(self.window())

    def agg(self, fn: Callable[[Column], Column], x: Column, n: int,
            min_periods: int | None = None) -> Column:
        """``fn`` over the last ``n`` rows, NULL until ``min_periods`` non-null values exist."""
        w = self.window(n)
        need = n if min_periods is None else min_periods
        return F.when(F.count(x).over(w) >= need, fn(x).over(w))

    def mean(self, x, n, min_periods=None):
        return self.agg(F.avg, x, n, min_periods)

    def std(self, x, n, min_periods=None):
        return self.agg(F.stddev_samp, x, n, min_periods)

    def var(self, x, n, min_periods=None):
        return self.agg(F.var_samp, x, n, min_periods)

    def sum(self, x, n, min_periods=None):
        return self.agg(F.sum, x, n, min_periods)

    def max(self, x, n, min_periods=None):
        return self.agg(F.max, x, n, min_periods)

    def min(self, x, n, min_periods=None):
        return self.agg(F.min, x, n, min_periods)

    def corr(self, a: Column, b: Column, n: int, min_periods: int | None = None) -> Column:
        """Correlation of pair-complete values; NULL when either side is constant."""
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
        w = self.window(n)
        need = n if min_periods is None else min_periods
        # every mention of a window expression is evaluated, so each appears once
        spread = F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)
        return F.when(F.count(a).over(w) >= need,
                      F.try_divide(F.covar_samp(a, b).over(w), spread))


def with_trailing(df: DataFrame, by: Sequence[str], order: Sequence[str], reach: int,
                  build: Callable[[DataFrame, Trail], DataFrame]) -> DataFrame:
    """Run ``build(frame, trail)``, which may look back at most ``reach`` rows in total.

    ``(by, order)`` must identify a row.  Groups above the limit are cut into slices of equal
    length and each slice is led by the ``reach`` rows before it, so every window is complete.
    """
    if not is_hot(df, by):
        return build(df, Trail(by, order))
    length = max(group_limit(df.sparkSession) // 2, reach, 1)
    pos = _positions(df, by, order, nulls=True).select(*by, *order, F.col("_below").alias("_rn"))
    at = F.expr(f"_rn div {length}")
    tail = F.col("_rn") % length >= length - reach
    ext = (
        join_back(df, pos, [*by, *order])
        .select("*", F.posexplode(F.when(tail, F.array(at, at + 1)).otherwise(F.array(at)))
                .alias("_halo", "_slice"))
        .drop("_rn")
    )
    # a slice is bounded by construction
    ext = annotate(ext, {"_slice": (length + reach, 0)})
    out = build(ext, Trail([*by, "_slice"], order))
    return out.where(F.col("_halo") == 0).drop("_halo", "_slice")


_RUNNING = {
    "sum": (F.sum, lambda carry, x: F.coalesce(carry + x, carry, x)),
    "product": (F.product, lambda carry, x: F.coalesce(carry * x, carry, x)),
    "max": (F.max, lambda carry, x: F.greatest(carry, x)),
    "last": (lambda x: F.last(x, ignorenulls=True), lambda carry, x: F.coalesce(x, carry)),
}


def with_running(df: DataFrame, by: Sequence[str], order: Sequence[str],
                 specs: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Running ``sum``, ``product``, ``max`` or ``last`` (non-null) up to the current row."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(UNB, 0)
    if not is_hot(df, by):
        return df.withColumns({n: _RUNNING[k][0](x).over(w) for n, (k, x) in specs.items()})
    length = max(group_limit(df.sparkSession) // 2, 1)
    pos = _positions(df, by, order, nulls=True).select(
        *by, *order, F.expr(f"_below div {length}").alias("_slice"))
    df = join_back(df, pos, [*by, *order]).withColumns(
        {f"_in_{n}": x for n, (_, x) in specs.items()})
    inner = W.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(UNB, 0)
    local = df.withColumns(
        {n: _RUNNING[k][0](F.col(f"_in_{n}")).over(inner) for n, (k, _) in specs.items()})
    ends = local.groupBy(*by, "_slice").agg(
        *[F.max_by(n, F.struct(*order)).alias(f"_end_{n}") for n in specs])
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(UNB, -1)
    carry = ends.select(*by, "_slice", *[
        _RUNNING[k][0](F.col(f"_end_{n}")).over(before).alias(f"_carry_{n}")
        for n, (k, _) in specs.items()])
    out = join_back(local, carry, [*by, "_slice"])
    out = out.withColumns(
        {n: _RUNNING[k][1](F.col(f"_carry_{n}"), F.col(n)) for n, (k, _) in specs.items()})
    return out.drop("_slice", *[f"_in_{n}" for n in specs], *[f"_carry_{n}" for n in specs])


# ------------------------------------------------------------------ ordinals


def distinct_ordinals(df: DataFrame, name: str, out: str = "_ord") -> DataFrame:
    """``(name, out)``: dense 0-based position of every distinct value over the whole frame."""
    values = df.select(name).where(F.col(name).isNotNull()).distinct()
    n = value_bound(df, name)
    if n <= group_limit(df.sparkSession):
        return values.withColumn(out, (F.row_number().over(W.orderBy(name)) - 1).cast("bigint"))
    whole = annotate(values.withColumn("_all", F.lit(1)), {"_all": (n, 1)})
    return _positions(whole, ["_all"], [name]).select(name, F.col("_below").alias(out))


def with_ordinal(df: DataFrame, name: str, out: str = "_ord") -> DataFrame:
    table = distinct_ordinals(df, name, out)
    if value_bound(df, name) <= BROADCAST_VALUES:
        table = F.broadcast(table)
    return df.join(table, name, "left")
