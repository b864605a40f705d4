"""Joins and group streams that the duplicate operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage

#: Most rows of narrow keys that are broadcast; above it the join is a merge of shuffled sides.
BROADCAST_ROWS = 500_000


def keys_side(keys: DataFrame) -> DataFrame:
    """A staged table of keys, marked to be broadcast if its counted rows are few, else to be merged."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("merge")


def whole_groups(frames: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Frames cut anew so that none splits a group; the input is clustered by ``by`` in sorted order.

    Holds a batch and the group that it leaves open, so groups must be bounded by what made them.
    """
    open_: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        last = frame[list(by)].iloc[-1].tolist()
        same = (frame[list(by)] == last).all(axis=1).to_numpy()
        cut = int(len(same) - same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield pd.concat([*open_, frame.iloc[:cut]], ignore_index=True) if open_ else frame.iloc[:cut].reset_index(drop=True)
            open_ = [frame.iloc[cut:]]
        elif open_ and open_[-1][list(by)].iloc[-1].tolist() != last:
            yield pd.concat(open_, ignore_index=True)
            open_ = [frame]
        else:
            open_.append(frame)
    if open_:
        yield pd.concat(open_, ignore_index=True)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, from ``a`` and ``b``; both are numbers.

    Large-star and small-star rounds on written tables until no edge changes. A node's neighbours are never gathered:
    each round takes minima and joins them back.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node, are tied to its smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = (large.join(least, F.col("u") == F.col("k")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        new = stage(small, "edges")
        sums = [t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first() for t in (e, new)]
        e = new
        if sums[0] == sums[1]:
            return e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").union(
                e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
