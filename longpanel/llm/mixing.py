"""Mixing sources to target weights, in blocks.

The words of a source are packed into blocks of ``block`` words, in an order fixed by hashed buckets and ``doc_id``.
Output shards of ``shard`` blocks draw how many blocks each source gives: the whole part of its expectation, and the
rest of the shard by a multinomial draw over the fractional parts. The draws of a source are numbered through all
shards; number ``j`` is mapped to a block by a pseudorandom permutation of the source's blocks, a new one for each pass
over them, and blocks are joined to documents by index. No block is drawn more than ``most`` times, so no document is
taken more than ``most`` times its size, however the draws fall.

Targets: sources in code point order (NULL last) weigh 1, 2, 3, repeating, and share the words of all; a target stops
at ``most`` times its source's size and the excess goes to the others by weight.

A NULL or empty text has size 0, is never taken and keeps its row; a NULL ``doc_id`` keeps its row too. Repeated rows
are documents of their own. A table without words has targets 0. Everything depends on the seed and the rows alone.

Only (doc_id, source, size) moves. No key is hot: the order within a source is a running sum over about
``sqrt(rows)`` hashed buckets of about ``sqrt(rows)`` rows, and blocks are joined on (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import partitions, stage
from .words import word_count

BLOCK = 32
SHARD = 1 << 16
MOST = 3
ROUNDS = 12
SEED = 7


def permuted(index: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of ``0 .. n-1`` chosen by ``key``.

    Swap-or-not, a bijection for every ``n``: each round has a key ``k``, pairs ``x`` with ``(k - x) mod n`` and swaps the
    pair if a hash of its larger member says so.
    """
    keys = F.array(*[F.pmod(F.xxhash64(*key, F.lit(r)), n) for r in range(rounds)])
    return F.aggregate(keys, index.cast("long"), lambda x, k: F.when(
        F.xxhash64(k, F.greatest(x, F.pmod(k - x, n))).bitwiseAND(1) == 0, x).otherwise(F.pmod(k - x, n)))


def source_targets(sizes: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """``source``, ``rank``, ``weight``, ``source_size``, ``blocks``, ``target``: one row a source.

    The level at which uncapped targets stand per unit of weight is found in one ordered pass over the sources.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("rank", F.row_number().over(order) - 1)
    s = s.withColumn("weight", (F.col("rank") % 3 + 1).cast("double"))
    cap = (F.col("source_size") * most).cast("double")
    by_level = Window.orderBy(cap / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
                     / F.sum("weight").over(after))
    s = s.withColumn("_open", cap / F.col("weight") > F.col("_level"))
    s = s.withColumn("_found", F.min(F.when(F.col("_open"), F.struct(cap / F.col("weight"), "rank", "_level"))).over(every))
    level = F.col("_found._level")
    target = F.when(level.isNull(), cap).otherwise(F.least(cap, level * F.col("weight")))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    return s.select("source", "rank", "weight", "source_size", blocks.alias("blocks"), target.alias("target"))


def packed(sizes: DataFrame, rows: int) -> DataFrame:
    """``sizes`` with ``at``: the number of words of its source before the document."""
    buckets = max(1, int(rows ** 0.5))
    t = sizes.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    sums = t.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"))
    head = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"),
                       F.coalesce(F.sum("_n").over(head), F.lit(0)).alias("_base"))
    own = Window.partitionBy("source", "_bucket").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    t = t.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    return t.select(*sizes.columns, (F.col("_base") + F.col("_own")).alias("at"))


def draws(targets: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``rank``, ``block``, ``times``: how often each block of each source is drawn."""
    spark = targets.sparkSession
    # a source's share of the slots is its target in blocks of its own mean length
    t = targets.withColumn("_want", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size"))
                           .otherwise(0.0))
    slots = int(round(t.agg(F.sum("_want")).first()[0] or 0))
    shards = -(-slots // shard)
    whole = Window.partitionBy(F.lit(0))
    t = t.withColumn("_p", F.col("_want") / F.sum("_want").over(whole))
    plan = t.agg(F.array_sort(F.collect_list(F.struct("rank", "_p", "blocks"))).alias("plan"))
    # one row a shard; the plan of the sources is one bounded row
    s = spark.range(shards).withColumn("_plan", plan.scalar())
    room = F.least(F.lit(shard), F.lit(slots) - F.col("id") * shard)
    s = s.withColumn("_room", room.cast("long"))
    s = s.withColumn("_sure", F.transform("_plan", lambda x: F.floor(x["_p"] * F.col("_room")).cast("long")))
    s = s.withColumn("_part", F.transform("_plan", lambda x: x["_p"] * F.col("_room") - F.floor(x["_p"] * F.col("_room"))))
    left = F.col("_room") - F.aggregate("_sure", F.lit(0).cast("long"), lambda a, x: a + x)
    span = F.aggregate("_part", F.lit(0.0), lambda a, x: a + x)
    s = s.withColumn("_left", F.greatest(F.lit(0).cast("long"), left)).withColumn("_span", span)

    def drawn(i: Column) -> Column:
        """The source of one left slot: the first whose cumulated fraction passes a uniform number."""
        u = (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1 << 52)) / float(1 << 52)) * F.col("_span")
        found = F.aggregate("_part", F.struct(u.alias("u"), F.lit(0).alias("k"), F.lit(-1).alias("at")), lambda a, x: F.struct(
            (a["u"] - x).alias("u"), (a["k"] + 1).alias("k"),
            F.when((a["at"] < 0) & (a["u"] < x), a["k"]).otherwise(a["at"]).alias("at")))
        return found["at"]

    s = s.withColumn("_extra", F.when(F.col("_left") > 0, F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("_left")), drawn)).otherwise(F.array().cast("array<int>")))
    n = F.transform("_plan", lambda x, k: F.struct(
        x["rank"].alias("rank"), x["blocks"].alias("blocks"),
        (F.col("_sure")[k] + F.size(F.filter(F.col("_extra"), lambda e: e == k))).alias("n")))
    s = s.select("id", F.inline(n))
    head = Window.partitionBy("rank").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_from", F.coalesce(F.sum("n").over(head), F.lit(0)))
    # pieces of bounded length, so that no task numbers a whole source
    piece = 4096
    s = s.where(F.col("n") > 0).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / piece))))
    s = s.select("rank", "blocks", (F.col("_from") + F.col("_k") * piece).alias("_lo"),
                 F.least(F.col("_from") + F.col("n"), F.col("_from") + (F.col("_k") + 1) * piece).alias("_hi"))
    s = s.repartition(partitions(s), "rank", "_lo")
    s = s.select("rank", "blocks", F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_j"))
    s = s.where(F.col("_j") < most * F.col("blocks"))
    s = s.select("rank", "blocks", F.floor(F.col("_j") / F.col("blocks")).alias("_pass"), (F.col("_j") % F.col("blocks")).alias("block"))
    s = s.select("rank", permuted(F.col("block"), F.col("blocks"), F.lit(seed), F.col("rank"), F.col("_pass")).alias("block"))
    return s.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST, seed: int = SEED,
        row: Column | None = None) -> DataFrame:
    """``row``, ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` of every document.

    ``row`` may name a number that tells repeated rows apart, for callers that join the result back.
    """
    sizes = stage(docs.select(
        (F.lit(0).cast("long") if row is None else row.cast("long")).alias("row"), "doc_id", "source",
        word_count(F.col("text")).alias("size")), "sizes")
    targets = stage(source_targets(sizes, block, most), "targets")
    at = packed(sizes, sizes.count())
    known = targets.select(F.col("source").alias("_s"), "rank", "source_size", "target")
    at = stage(at.join(F.broadcast(known) if targets.count() <= 100_000 else known,
                       F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
               .withColumn("piece", F.monotonically_increasing_id()), "packed")
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    cut = (at.where("size > 0").select("piece", "rank", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
           .withColumn("n", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
                       - F.greatest("at", F.col("block") * block)))
    # draws come from exploded numbers, which Spark takes for a few rows: they must not be broadcast
    got = (cut.join(draws(targets, block, shard, most, seed).hint("merge"), ["rank", "block"])
           .groupBy("piece").agg(F.sum(F.col("n") * F.col("times")).alias("taken")))
    return at.join(got, "piece", "left").select(
        "row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
