"""The prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of the first ``d`` turns of a conversation. Prefixes are told apart by 128 bits: the
exclusive or of hashes of (place, role, text), which running aggregates of bounded blocks give for conversations of any
length. A node's owner is its smallest member.

* Nodes with the same members are one segment (a radix trie), keyed by owner and number of members: at most two segments
  for each different conversation, however long it is. Only segments are sent through queues.
* Segments with more than ``rows / TOPS`` members are tops; each of their nodes is a row of so many conversations, so there
  are at most ``TOPS`` of them, and the root. What hangs below the tops is cut into shards, each a subtree of few members,
  found for each conversation by the last top on its way; shards are dealt over tasks by hash.
* Within a shard segments are sorted in reverse level order, by Spark's external sort. A task reads them once: it takes
  what the queue holds for a segment, adds the segment's own, and sends the totals forward to the parent, which comes
  later. The queue keeps bounded memory and spills sorted runs to temporary files that end with the task, as Spark's own
  sort does.
* Totals of the shards' roots are summed by the top they hang on (map-side first), and the tops, a bounded number, are
  processed in the same way in one task. Nodes then take their segment's totals and add what lies between.

NULL role and text are empty; turns are in order of ``turn``, NULL first, ties by a hash of role and text. Rows without a
``conv_id`` belong to no conversation. Repeated rows are turns of their own. An empty table has no members and no nodes.
Long texts are only hashed and counted. Only the four columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import keys_side
from .scratch import partitions, stage
from .words import word_count

#: Bound of the number of top nodes, and of places in a block of a conversation.
TOPS, BLOCK = 4096, 1024
#: Messages that a queue holds in memory, and conversations in a piece of a list.
IN_MEMORY, IDS = 200_000, 50_000


# ------------------------------------------------------------------ turns


def turns(conversations: DataFrame) -> DataFrame:
    """``conv``, ``k`` (place from 0), hashes ``a`` and ``b`` of role and text, and ``n_words``; written.

    One range shuffle of narrow rows: places are counted along the sorted partitions, and a conversation that spans
    several of them gets the counts before: at most two rows for each partition.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("turn"), text, role).alias("b"), word_count(F.col("text")).alias("n_words"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    t = t.repartitionByRange(partitions(conversations), *order).sortWithinPartitions(*order)
    t = t.select("conv", F.spark_partition_id().alias("p"), "a", "b", "n_words")

    def number(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, seen = None, 0
        for batch in batches:
            conv = batch.column("conv").to_numpy()
            if not len(conv):
                continue
            new = np.concatenate(([conv[0] != last], conv[1:] != conv[:-1]))
            at = np.arange(len(conv))
            first = np.maximum.accumulate(np.where(new, at, 0))
            k = at - first + np.where(np.cumsum(new) == 0, seen, 0)
            last, seen = conv[-1], int(k[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k)], [*batch.schema.names, "k"])

    t = stage(t.mapInArrow(number, "conv long, p int, a long, b long, n_words long, k long"), "turns")
    spans = t.groupBy("conv", "p").agg(F.count(F.lit(1)).alias("n"))
    several = spans.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("s")).where(F.size("s") > 1)
    before = several.select("conv", F.posexplode("s").alias("i", "x"), "s").select(
        "conv", F.col("x.p").alias("p"),
        F.aggregate(F.slice("s", 1, F.col("i")), F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("before"))
    t = t.join(keys_side(stage(before, "spans")), ["conv", "p"], "left")
    return t.select("conv", (F.col("k") + F.coalesce("before", F.lit(0))).alias("k"), "a", "b", "n_words")


def rebuilt(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of every conversation behind a head borrowed from the first of its twenty; and all conversations."""
    h = F.crc32(F.col("conv").cast("string")) % 4
    convs = stage(t.groupBy("conv").agg((F.max("k") + 1).alias("n")).withColumn("h", h).withColumn("base", F.expr("conv - conv % 20")), "convs")
    heads = stage(t.where("conv % 20 = 0 AND k < 3").withColumnRenamed("conv", "base"), "heads")
    borrowed = convs.join(heads, "base").where("k < h").select("conv", "k", "a", "b", "n_words")
    length = convs.where("conv % 20 = 0").select(F.col("conv").alias("base"), F.col("n").alias("has"))
    # a base that is missing or short moves the own turns forward
    moved = convs.where("h > 0").join(length, "base", "left").select("conv", (F.least("h", F.coalesce("has", F.lit(0))) - F.col("h")).alias("by"))
    own = t.where(F.col("k") >= h).join(keys_side(stage(moved.where("by <> 0"), "moved")), "conv", "left")
    own = own.select("conv", (F.col("k") + F.coalesce("by", F.lit(0))).alias("k"), "a", "b", "n_words")
    return own.unionByName(borrowed), convs.select("conv")


# ------------------------------------------------------------------ prefixes and segments


def running(df: DataFrame, key: list[str], outs: dict[str, tuple], back: bool = False) -> DataFrame:
    """Running aggregates along ``d`` within ``key``, from the end if ``back``; a task holds a block, not a key.

    ``outs``: name -> (aggregate, column, how a block takes in what stands before it). The blocks of keys that have more
    than one are carried in a table a block.
    """
    by = (lambda c: F.col(c).desc()) if back else F.col
    block = F.expr(f"d div {BLOCK}")
    df = df.withColumn("block", block)
    inner = W.partitionBy(*key, "block").orderBy(by("d")).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumns({n: fn(c).over(inner) for n, (fn, c, _) in outs.items()})
    long = df.where(f"d >= {BLOCK}").select(*key).distinct()
    sums = df.join(keys_side(stage(long, "long")), key, "left_semi").groupBy(*key, "block").agg(*[fn(c).alias(n) for n, (fn, c, _) in outs.items()])
    before = W.partitionBy(*key).orderBy(by("block")).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(*key, "block", *[fn(F.col(n)).over(before).alias(f"{n}_before") for n, (fn, _, _) in outs.items()])
    out = out.join(keys_side(stage(carried, "carried")), [*key, "block"], "left")
    return out.withColumns({n: F.coalesce(merge(F.col(n), F.col(f"{n}_before")), F.col(n)) for n, (_, _, merge) in outs.items()}).drop(
        "block", *[f"{n}_before" for n in outs])


def prefixes(t: DataFrame) -> DataFrame:
    """``conv``, ``d`` from 1, fingerprint ``px, py`` of the first ``d`` turns and ``qx, qy`` of one fewer; written."""
    t = t.select("conv", (F.col("k") + 1).alias("d"), "n_words", F.xxhash64((F.col("k") + 1), "a", "b").alias("x"),
                 F.xxhash64(F.lit("place"), "b", "a", F.col("k") + 1).alias("y"))
    xor = lambda a, b: a.bitwiseXOR(b)
    t = running(t, ["conv"], {"px": (F.bit_xor, F.col("x"), xor), "py": (F.bit_xor, F.col("y"), xor)})
    return stage(t.select("conv", "d", "px", "py", xor(F.col("px"), F.col("x")).alias("qx"), xor(F.col("py"), F.col("y")).alias("qy"), "n_words"), "prefixes")


def nodes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: ``d, px, py``, owner ``conv``, ``n`` members, the words of its last text, and its parent; written."""
    zero = F.lit(0).cast("long")
    below = rows.groupBy("d", "px", "py").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("n_words").alias("n_words"),
                                              F.max("qx").alias("qx"), F.max("qy").alias("qy"))
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).where("n > 0").select(
        zero.alias("d"), zero.alias("px"), zero.alias("py"), "conv", "n", zero.alias("n_words"), F.lit(None).cast("long").alias("qx"),
        F.lit(None).cast("long").alias("qy"))
    return stage(below.unionByName(root), "nodes")


def segments_of(nodes: DataFrame) -> DataFrame:
    """Chains of nodes with the same members: depths ``top`` to ``bottom``, tokens saved, and the parent segment; written.

    The parent of a segment's top is the bottom of another: a node whose members go on together has one child.
    """
    s = nodes.groupBy("conv", "n").agg(
        F.min("d").alias("top"), F.max("d").alias("bottom"), F.sum((F.col("n") - 1) * F.col("n_words")).alias("own"),
        F.min_by(F.struct("qx", "qy"), "d").alias("q"), F.max_by(F.struct("px", "py"), "d").alias("b"))
    s = stage(s.select("conv", "n", "top", "bottom", "own", "q.qx", "q.qy", F.col("b.px").alias("bx"), F.col("b.py").alias("by")), "segments")
    up = s.select((F.col("bottom") + 1).alias("top"), F.col("bx").alias("qx"), F.col("by").alias("qy"), F.col("conv").alias("p_conv"),
                  F.col("n").alias("p_n"), F.col("top").alias("p_top"))
    return stage(s.join(up, ["top", "qx", "qy"], "left"), "parents")


# ------------------------------------------------------------------ time-forward processing


class SpillingQueue:
    """Messages (three numbers of the receiver's place in the order, leaves, tokens), smallest place first."""

    def __init__(self, limit: int) -> None:
        self.limit, self.heap, self.heads, self.runs = limit, [], [], []

    def push(self, place: tuple[int, int, int], leaves: int, saved: int) -> None:
        heappush(self.heap, (*place, leaves, saved))
        if len(self.heap) > self.limit:
            self.spill()

    def spill(self) -> None:
        """Everything in memory becomes a sorted run in a file without a name."""
        f = tempfile.TemporaryFile()
        np.array(sorted(self.heap), np.int64).tofile(f)
        f.seek(0)
        self.heap = []
        self.runs.append(self._read(f))
        self._next(len(self.runs) - 1)

    def _read(self, f) -> Iterator[tuple]:
        with f:
            while len(part := np.fromfile(f, np.int64, 5 * 4096)):
                yield from map(tuple, part.reshape(-1, 5).tolist())

    def _next(self, run: int) -> None:
        if (m := next(self.runs[run], None)) is not None:
            heappush(self.heads, (m, run))

    def take(self, place: tuple[int, int, int]) -> tuple[int, int, int]:
        """Number and sums of the messages for ``place``; no message may be for an earlier place."""
        count = leaves = saved = 0
        while True:
            if self.heap and self.heap[0][:3] <= place:
                m = heappop(self.heap)
            elif self.heads and self.heads[0][0][:3] <= place:
                m, run = heappop(self.heads)
                self._next(run)
            else:
                return count, leaves, saved
            if m[:3] != place:
                raise ValueError(f"a message for {m[:3]} was left at {place}")
            count, leaves, saved = count + 1, leaves + m[3], saved + m[4]


TOTALS = "conv long, n long, n_children long, n_leaves long, below long, p_conv long, p_n long"


def forward(segments: DataFrame, limit: int) -> DataFrame:
    """Totals of segments whose partitions hold whole subtrees, each sorted by ``top`` descending, ``conv``, ``n``.

    ``inside`` says whether the parent is in the same partition; ``from_*`` is what has come from outside.
    """

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        queue = SpillingQueue(limit)
        names = ["conv", "n", "n_children", "n_leaves", "below", "p_conv", "p_n"]
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (
                "conv", "n", "top", "own", "p_conv", "p_n", "p_top", "inside", "from_children", "from_leaves", "from_saved")]
            out = []
            for conv, n, top, own, p_conv, p_n, p_top, inside, more, more_leaves, more_saved in zip(*cols):
                count, leaves, saved = queue.take((-top, conv, n))
                count, leaves, saved = count + more, leaves + more_leaves, saved + more_saved
                if not count:
                    leaves = 1
                out.append((conv, n, count, leaves, saved, p_conv, p_n))
                if inside:
                    queue.push((-p_top, p_conv, p_n), leaves, saved + own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return segments.mapInArrow(send, TOTALS)


def totals(segments: DataFrame, rows: DataFrame, tops: int | None = None, in_memory: int | None = None) -> DataFrame:
    """Children, leaves and tokens saved below every segment: within shards, then across their roots."""
    tops, in_memory = tops or TOPS, in_memory or IN_MEMORY
    parts = partitions(segments)
    least = -(-rows.count() // tops)
    top = F.col("top") == 0
    s = segments.withColumn("is_top", top | (F.col("n") > least)).withColumn("p_is_top", (F.col("p_top") == 0) | (F.col("p_n") > least))
    zero = {f"from_{c}": F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
    order = [F.col("top").desc(), "conv", "n"]
    # of each conversation the last node behind a top: the root of its shard. At most TOPS + 1 rows are broadcast
    cut = s.where("is_top").select((F.col("bottom") + 1).alias("d"), F.col("bx").alias("qx"), F.col("by").alias("qy"))
    roots = rows.join(F.broadcast(cut), ["d", "qx", "qy"]).groupBy("conv").agg(F.max_by(F.xxhash64("px", "py"), "d").alias("shard"))
    below = s.where("NOT is_top").join(roots, "conv").withColumns({**zero, "inside": ~F.col("p_is_top")})
    done = stage(forward(below.repartition(parts, "shard").sortWithinPartitions(*order), in_memory), "totals")
    own = s.select("conv", "n", "own", "p_is_top")
    handed = (done.join(own, ["conv", "n"]).where("p_is_top").groupBy(F.col("p_conv").alias("conv"), F.col("p_n").alias("n"))
              .agg(F.count(F.lit(1)).alias("from_children"), F.sum("n_leaves").alias("from_leaves"), F.sum(F.col("below") + F.col("own")).alias("from_saved")))
    upper = s.where("is_top").join(handed, ["conv", "n"], "left").fillna(0, list(zero)).withColumn("inside", F.col("p_top").isNotNull())
    return done.unionByName(forward(upper.repartition(1).sortWithinPartitions(*order), in_memory))


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined, ascending conversations that end at each node ``d, px, py``.

    The lists are cut by ranges, so that a node where a third of all conversations end is many tasks' work; only text
    pieces meet, and one task at a time passes them through the digest.
    """
    node = ["d", "px", "py"]

    def listed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, seq = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            part = batch.column("part")[0].as_py()
            keys = np.stack([batch.column(c).to_numpy() for c in node], axis=1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            cuts = sorted({0, n, *cuts.tolist(), *range(0, n, IDS)})
            conv = batch.column("conv").to_pylist()
            out = [(*keys[a].tolist(), part, seq + i, ",".join(map(str, conv[a:b]))) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            seq += len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*node, "part", "seq", "ids"])

    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, sha = None, None
        kind = pa.schema([*((c, pa.int64()) for c in node), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for *k, ids in zip(*(batch.column(c).to_pylist() for c in (*node, "ids"))):
                if k == key:
                    sha.update(b",")
                else:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, x)) for x in out], kind)
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, (*key, sha.hexdigest())))], kind)

    parts = partitions(ends)
    e = ends.repartitionByRange(parts, *node, "conv").sortWithinPartitions(*node, "conv").withColumn("part", F.spark_partition_id().cast("long"))
    # written, as a second run might cut the ranges elsewhere
    pieces = stage(e.mapInArrow(listed, "d long, px long, py long, part long, seq long, ids string"), "ends")
    pieces = pieces.repartition(parts, *node).sortWithinPartitions(*node, "part", "seq")
    return pieces.mapInArrow(digest, "d long, px long, py long, ends_sha256 string")


def trie(t: DataFrame, convs: DataFrame, tops: int | None = None, in_memory: int | None = None) -> DataFrame:
    """All nodes of the trie of ``conv, k, a, b, n_words``; ``convs`` has every conversation once, also those without turns."""
    rows = prefixes(t)
    nodes = nodes_of(rows, convs)
    segments = segments_of(nodes)
    sums = totals(segments, rows, tops, in_memory)
    last = rows.groupBy("conv").agg(F.max_by(F.struct("d", "px", "py"), "d").alias("e")).select("conv", "e.*")
    zero = F.lit(0).cast("long")
    none = convs.join(last.select("conv"), "conv", "left_anti").select("conv", zero.alias("d"), zero.alias("px"), zero.alias("py"))
    digests = end_digests(last.unionByName(none))
    # what a node saves: its segment from it downwards, and what lies below the segment
    nodes = running(nodes, ["conv", "n"], {"rest": (F.sum, (F.col("n") - 1) * F.col("n_words"), lambda a, b: a + b)}, back=True)
    spans = segments.select("conv", "n", "top", "bottom", F.col("p_conv").alias("up"))
    of = spans.join(sums.drop("p_conv", "p_n"), ["conv", "n"])
    out = nodes.join(of, ["conv", "n"]).join(digests, ["d", "px", "py"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") > F.col("top"), F.col("conv")).otherwise(F.col("up")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(F.col("d") < F.col("bottom"), 1).otherwise(F.col("n_children")).cast("long").alias("n_children"),
        "n_leaves", (F.col("rest") + F.col("below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, tops: int | None = None, in_memory: int | None = None) -> DataFrame:
    """The trie of all conversations, each behind its borrowed head."""
    return trie(*rebuilt(turns(conversations)), tops, in_memory)
