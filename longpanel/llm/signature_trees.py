"""Jaccard join of documents on word n-grams, exact, by signature trees.

A document's set holds the 64-bit hashes of its distinct runs of five words (``A-Z`` lower-cased; with fewer words, of
the whole sequence). Two documents link when ``100 * |intersection| >= 80 * |union|``.

1. Each set gives its digest, its size, a bitmap (a bit for each hash, at least as wide as the set) and its prefix: the
   first members in an order that all sets share. Sets that reach the threshold share a prefix member. The order puts
   members that a bounded sample shows to be frequent last, which keeps groups small; any order gives the same links.
2. Documents with equal digests are one node. Nodes that share a prefix member form a group; of groups with equal
   members one stays. A group beyond ``BLOCK`` nodes is dealt into blocks, and every pair of its blocks is a group.
3. In each group a signature tree is built: nodes hold the OR and the AND of the bitmaps below and the range of sizes. A
   dual traversal drops pairs of nodes whose largest possible overlap cannot reach the threshold. What it leaves are
   possible links; a spanning forest of them is kept for each group, and their components are clusters.
4. The whole set of each clustered document is read from its text and goes to its cluster once. There the same traversal
   on the sets' bitmaps, with an exact count of the intersection, gives the links; clusters beyond ``BLOCK`` nodes are
   dealt into blocks as groups are.

Components are found on written tables. A link between two documents that others join already may stay uncounted; no
two components have a link between them.

NULL, empty and wordless texts have an empty set and stand alone. Repeated rows share a set and so a component; ties do
not arise. The smallest key of a component is its id; NULL keys are never chosen. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import components, keys_side, whole_groups
from .memory import releasing
from .scratch import partitions, stage
from .words import U, batches, gram_hashes, mix, word_hashes

N = 5
BLOCK = 2048
SAMPLE_ROWS, SAMPLE_SEEN, SAMPLE_LONGEST = 4096, 8, 20_000
FAN, LEAF = 8, 16


def least_overlap(n: int) -> int:
    """Smallest intersection of a set of ``n`` with any set that it links to."""
    return -(-4 * n // 5)


def text_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text."""
    raw = [t.encode().lower() if isinstance(t, str) else b"" for t in texts]
    for a, b in batches([len(t) for t in raw]):
        words, row, *_ = word_hashes(raw[a:b])
        at = np.searchsorted(row, np.arange(b - a + 1))
        grams = gram_hashes(words, N)
        for lo, hi in zip(at[:-1], at[1:]):
            if hi - lo >= N:
                yield np.unique(grams[lo:hi - N + 1])
            else:
                yield gram_hashes(words[lo:hi], int(hi - lo)) ^ U(hi - lo) if hi > lo else np.empty(0, np.uint64)


def digest(s: np.ndarray) -> int:
    """A signed 64-bit number for a set."""
    return int(mix(np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + U(len(s))], np.uint64))[0].astype(np.int64))


def width(n: int) -> int:
    """Words of 64 bits in the bitmap of ``n`` members."""
    return max(1, 1 << max(0, (n - 1).bit_length() - 6))


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * width(len(s)), np.uint8)
    bits[(s >> U(16)) & U(len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: two members of a pair of sets of 20,000 agree by chance once in 700,000 pairs."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


# ------------------------------------------------------------------ signature trees


class Tree:
    """Signature tree over rows of a bitmap matrix, sorted by size: levels of (OR, AND, least size, largest size)."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray) -> None:
        self.bits, self.sizes = bits, sizes
        self.levels = []
        either, every, low, high = bits, bits, sizes, sizes
        step = LEAF
        while True:
            cut = np.arange(0, len(low), step)
            either, every = np.bitwise_or.reduceat(either, cut, axis=0), np.bitwise_and.reduceat(every, cut, axis=0)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((either, every, low, high))
            if len(cut) == 1:
                return
            step = FAN

    def below(self, level: int, i: int) -> range:
        """Nodes of the level below, or rows under a leaf."""
        if level == 0:
            return range(i * LEAF, min(len(self.sizes), (i + 1) * LEAF))
        return range(i * FAN, min(len(self.levels[level - 1][2]), (i + 1) * FAN))

    def rows(self, level: int, i: int) -> slice:
        span = LEAF * FAN ** level
        return slice(i * span, min(len(self.sizes), (i + 1) * span))


def _may_link(every_a, low_a, high_a, either_a, every_b, low_b, high_b, either_b) -> np.ndarray:
    """Whether sets below the one side may reach the threshold with sets below the other; broadcasts over both."""
    only_a = np.bitwise_count(every_a & ~either_b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(every_b & ~either_a).sum(-1, dtype=np.int64)
    # |x - y| is at most |x| - 4/9 (|x| + |y|) for sets that link
    return ((4 * low_b <= 5 * high_a) & (4 * low_a <= 5 * high_b)
            & (9 * only_a <= 5 * high_a - 4 * low_b) & (9 * only_b <= 5 * high_b - 4 * low_a))


def traverse(a: Tree, b: Tree, same: bool, skip, visit) -> None:
    """Dual traversal; ``visit(rows of a, rows of b)`` gets aligned arrays of the pairs that may link.

    ``skip(slice of a, slice of b)`` may declare a pair of nodes of no interest.
    """
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if skip(a.rows(la, i), b.rows(lb, j)):
            continue
        if la == lb == 0:
            x, y = a.rows(0, i), b.rows(0, j)
            ok = _may_link(a.bits[x][:, None], a.sizes[x][:, None], a.sizes[x][:, None], a.bits[x][:, None],
                           b.bits[y][None], b.sizes[y][None], b.sizes[y][None], b.bits[y][None])
            if same and i == j:
                ok &= np.tri(*ok.shape, -1, dtype=bool).T
            p, q = np.nonzero(ok)
            if len(p):
                visit(p + x.start, q + y.start)
            continue
        own_a = [(la - 1, k) for k in a.below(la, i)] if la and la >= lb else [(la, i)]
        own_b = [(lb - 1, k) for k in b.below(lb, j)] if lb and lb >= la else [(lb, j)]
        ka, kb = np.array([k for _, k in own_a]), np.array([k for _, k in own_b])
        (ea, va, na, xa), (eb, vb, nb, xb) = a.levels[own_a[0][0]], b.levels[own_b[0][0]]
        ok = _may_link(va[ka][:, None], na[ka][:, None], xa[ka][:, None], ea[ka][:, None],
                       vb[kb][None], nb[kb][None], xb[kb][None], eb[kb][None])
        for p, q in zip(*np.nonzero(ok)):
            if not same or (own_a[p][0], ka[p]) <= (own_b[q][0], kb[q]) or own_a[p][0] != own_b[q][0]:
                stack.append((*own_a[p], *own_b[q]))


def halved(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width: the bit of a hash is taken modulo the width."""
    h = bits.shape[1] // 2
    return bits[:, :h] | bits[:, h:]


def candidate_pairs(sizes: np.ndarray, maps: list[bytes], skip, visit) -> None:
    """Traverse the trees of a group by bitmap width: sets that link have equal or neighbouring widths.

    ``skip`` and ``visit`` get row numbers of the group.
    """
    words = np.array([len(m) for m in maps])
    trees: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in np.unique(words):
        rows = np.flatnonzero(words == w)
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        trees[int(w)] = rows, np.frombuffer(b"".join(maps[r] for r in rows), np.uint64).reshape(len(rows), -1)
    for w, (rows, bits) in trees.items():
        t = Tree(bits, sizes[rows])
        traverse(t, t, True, lambda x, y: skip(rows[x], rows[y]), lambda p, q: visit(rows[p], rows[q]))
        if 2 * w in trees:
            more, wide = trees[2 * w]
            traverse(t, Tree(halved(wide), sizes[more]), False, lambda x, y: skip(rows[x], more[y]), lambda p, q: visit(rows[p], more[q]))


class Forest:
    """Union-find over the rows of a group."""

    def __init__(self, start: np.ndarray) -> None:
        """``start``: rows with equal values are in one component from the beginning."""
        _, self.of = np.unique(start, return_inverse=True)
        self.of = self.of.copy()

    def one(self, x: np.ndarray, y: np.ndarray) -> bool:
        """Whether all rows are in one component."""
        c = self.of[x[0]]
        return bool((self.of[x] == c).all() and (self.of[y] == c).all())

    def join(self, a: int, b: int) -> None:
        self.of[self.of == self.of[b]] = self.of[a]


def possible_links(sizes: np.ndarray, maps: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of rows that may link by their bitmaps: as many as join all rows that chains of such pairs join."""
    forest, out = Forest(np.arange(len(sizes))), []

    def visit(p, q):
        for i, j in zip(p, q):
            if forest.of[i] != forest.of[j]:
                forest.join(i, j)
                out.append((int(i), int(j)))

    candidate_pairs(sizes, maps, forest.one, visit)
    return out


def links(sizes: np.ndarray, maps: list[bytes], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between rows of a group: as many as join all rows that its links join."""
    forest, out = Forest(np.arange(len(sizes))), []
    whole = sets.__getitem__

    def visit(p, q):
        for i, j in zip(p, q):
            if forest.of[i] != forest.of[j]:
                x, y = (whole(i), whole(j)) if sizes[i] <= sizes[j] else (whole(j), whole(i))
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    forest.join(i, j)
                    out.append((int(i), int(j)))

    candidate_pairs(sizes, maps, forest.one, visit)
    return out


# ------------------------------------------------------------------ on Spark


def frequent(docs: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Hashes in ``SAMPLE_SEEN`` or more distinct sets of a bounded sample; they only set the order of prefixes."""
    n = docs.count()
    h = F.pmod(F.xxhash64("text", F.lit("order")), F.lit(1 << 30))
    few = docs.where(F.col("text").isNotNull() & (h < F.lit(max(1, int((1 << 30) * min(1.0, rows / max(1, n)))))))

    def members(frames):
        for frame in frames:
            for s in text_sets(list(frame["text"])):
                if 0 < len(s) <= SAMPLE_LONGEST:
                    yield pd.DataFrame({"h": s.astype(np.int64)})

    # a text has one hash, so copies are in or out together: they count once
    seen = few.select("text").distinct().limit(4 * rows).mapInPandas(releasing(members), "h long").groupBy("h").count()
    found = seen.where(F.col("count") >= SAMPLE_SEEN).select("h").toArrow()["h"].to_numpy()
    return np.sort(found.astype(np.uint64))


def sketches(docs: DataFrame, key: str) -> DataFrame:
    """``key``, ``node`` (digest), ``n``, ``bits`` and ``prefix``; a task gives a node's bits and prefix once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs))
    kind = docs.schema[key].dataType.simpleString()

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = shared.value
        known: set[int] = set()
        for frame in (f.iloc[at:at + 1000] for f in frames for at in range(0, len(f), 1000)):
            node, size, bits, prefix = [], [], [], []
            for s in text_sets(list(frame["text"])):
                d = digest(s)
                node.append(d)
                size.append(len(s))
                if d in known or not len(s):
                    bits.append(None)
                    prefix.append(None)
                    continue
                known.add(d)
                bits.append(bitmap(s).tobytes())
                p = len(s) - least_overlap(len(s)) + 1
                if len(often):
                    rare = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] != s
                    s = np.concatenate((s[rare], s[~rare]))
                prefix.append(s[:p].astype(np.int64))
            yield pd.DataFrame({"key": frame["key"].to_numpy(), "node": node, "n": size, "bits": bits, "prefix": prefix})

    return docs.select(F.col(key).alias("key"), "text").mapInPandas(
        releasing(make), f"key {kind}, node long, n long, bits binary, prefix array<long>")


def groups(made: DataFrame) -> DataFrame:
    """``g``, ``node``: groups of nodes that share a prefix member, one of those with equal members."""
    rows = made.where(F.col("prefix").isNotNull()).select(F.explode("prefix").alias("g"), "node")
    by = Window.partitionBy("g").orderBy("node")
    rows = rows.withColumn("before", F.lag("node").over(by)).where(F.col("before").isNull() | (F.col("before") != F.col("node")))
    whole = Window.partitionBy("g")
    rows = rows.select("g", "node", F.count(F.lit(1)).over(whole).alias("size"), F.min("node").over(whole).alias("least"),
                       F.bit_xor("node").over(whole).alias("x"), F.bit_xor(F.xxhash64("node")).over(whole).alias("y"))
    rows = stage(rows.where("size > 1"), "groups")
    kept = rows.where("node = least").groupBy("size", "least", "x", "y").agg(F.min("g").alias("g")).select("g")
    return rows.select("g", "node", "size").join(keys_side(stage(kept, "kept-groups")), "g", "left_semi")


def blocked(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` of (g, node, size) with ``i``, ``j``: groups beyond ``block`` rows become pairs of blocks."""
    m = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit("block")), m).cast("int")
    t = rows.withColumn("_m", m).withColumn("_own", own)
    t = t.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return t.withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other")).drop("_m", "_own", "_other")


def _by_group(df: DataFrame, work, schema: str) -> DataFrame:
    """``work(frame of whole groups, bounds)`` on rows clustered by (g, i, j)."""
    by = ["g", "i", "j"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, by):
            k = frame[by].to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(1), [True])))
            yield from work(frame, edge)

    return df.repartition(partitions(df), *by).sortWithinPartitions(*by).mapInPandas(releasing(run), schema)


def _possible(frame: pd.DataFrame, edge: np.ndarray) -> Iterator[pd.DataFrame]:
    sizes, maps, node = frame["n"].to_numpy(np.int64), list(frame["bits"]), frame["node"].to_numpy()
    out = []
    for a, b in zip(edge[:-1], edge[1:]):
        if b - a > 1:
            out += [(node[a + i], node[a + j]) for i, j in possible_links(sizes[a:b], maps[a:b])]
    yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _links(frame: pd.DataFrame, edge: np.ndarray) -> Iterator[pd.DataFrame]:
    node, members = frame["node"].to_numpy(), list(frame["members"])
    out = []
    for a, b in zip(edge[:-1], edge[1:]):
        if b - a > 1:
            sets = [unpacked(m) for m in members[a:b]]
            maps = [bitmap(s).tobytes() for s in sets]
            out += [(node[a + i], node[a + j]) for i, j in links(np.array([len(s) for s in sets]), maps, sets)]
    yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def linked(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` of every row."""
    made = stage(sketches(docs, key), "sketches")
    spark = docs.sparkSession
    signs = stage(made.where(F.col("bits").isNotNull()).select("node", "n", "bits").dropDuplicates(["node"]), "signatures")
    may = stage(_by_group(blocked(groups(made)).join(signs.hint("merge"), "node"), _possible, "a long, b long"), "possible")
    # chains of possible links form clusters; every link lies within one
    clusters = stage(components(may), "clusters")
    size = F.count(F.lit(1)).over(Window.partitionBy("label"))
    rows = stage(blocked(clusters.select(F.col("label").alias("g"), "node", size.alias("size"))), "to-compare")
    # a row that has each node's set, found by key and told apart by digest
    rep = made.join(keys_side(stage(clusters.select("node"), "wanted")), "node", "left_semi").groupBy("node").agg(F.min("key").alias("k"))
    rep = stage(rep.select("k").distinct(), "representatives")

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 500):
                few = frame.iloc[at:at + 500]
                out = [(digest(s), packed(s)) for s in text_sets(list(few["text"])) if len(s)]
                yield pd.DataFrame(out, columns=["node", "members"])

    # whole sets are read from the texts and go straight to their clusters
    sets = docs.select(F.col(key).alias("key"), "text").join(keys_side(rep), F.col("key").eqNullSafe(F.col("k")), "left_semi")
    sets = sets.mapInPandas(releasing(fetch), "node long, members binary")
    found = stage(_by_group(sets.join(keys_side(rows), "node"), _links, "a long, b long"), "links")
    final = stage(components(found), "components")
    ids = (made.where("n > 0").groupBy("node").agg(F.min("key").alias("key")).join(final, "node", "left")
           .select("node", "key", F.coalesce("label", "node").alias("label")))
    least = ids.groupBy("label").agg(F.min("key").alias("component_id"))
    of = stage(ids.join(least, "label").select("node", "component_id"), "component-ids")
    return made.select("key", "node", F.col("n").alias("n_shingles")).join(of.hint("merge"), "node", "left").select(
        F.col("key").alias(key), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))
