"""URL filter: prefix rules, and a ratio of two character models where no rule fits.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give each character a probability from
contexts of zero to four characters, each order leaning on the one below. The score of a URL is the sum of
``log p_accepted - log p_rejected`` over its characters divided by their number; a threshold calibrated on URLs held
out of the counts turns it into a verdict.

URLs that a rule allows or blocks are the training rows, all of them. Counts are a table keyed by the characters
themselves, so the model grows with the input and no two contexts are mixed. What a character adds to a score follows
from it and the ``ORDER`` before it: it is computed once for each distinct run of ``ORDER + 1`` characters and joined to
the characters, as a broadcast while the counted runs are at most ``joins.BROADCAST_ROWS``, else by a merge. Parts of a
score are summed as whole numbers, so both plans give the same.

NULL or empty URLs have an empty host and path, fit no rule, score 0 and are blocked. Repeated rows are judged alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins
from .joins import keys_side
from .rows import with_row
from .scratch import stage

ORDER = 4
SYMBOLS = 64.0
LEAN = 2.0
PAD = "^" * ORDER
#: Parts of a score in one unit of it.
UNIT = float(1 << 40)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host_: Column, path_: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule whose host or a subdomain of it, and whose path's start, fit; NULL if none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _folded(url: Column) -> Column:
    """Lower case, digits alike, everything outside printable ASCII alike, led by padding."""
    t = F.translate(F.coalesce(url, F.lit("")), UPPER + "123456789", LOWER + "0" * 9)
    return F.concat(F.lit(PAD), F.regexp_replace(t, r"[^\x21-\x7E]", "~"))


def _characters(t: DataFrame) -> DataFrame:
    """A row for each character of ``_u``, its place in ``_i``; rows without characters give none."""
    return t.where(F.length("_u") > ORDER).withColumn("_i", F.explode(F.sequence(F.lit(ORDER + 1), F.length("_u"))))


def _runs(t: DataFrame) -> DataFrame:
    """``_characters`` with ``gram``, a character and the ``ORDER`` before it."""
    return _characters(t).withColumn("gram", F.substring(F.col("_u"), F.col("_i") - ORDER, F.lit(ORDER + 1)))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``k``, ``kind``, ``s``, ``a``, ``r``: how often accepted and rejected URLs have a gram (kind g, ``k + 1`` characters)
    and a context (kind c, ``k`` characters and any after them)."""
    chars = _runs(labelled.withColumn("_u", _folded(F.col("url"))))
    runs = chars.groupBy("gram").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    parts = [F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.substring("gram", ORDER + 1 - k, k + (kind == "g")).alias("s"))
             for k in range(ORDER + 1) for kind in "gc"]
    return (runs.select(F.inline(F.array(*parts)), "a", "r").groupBy("k", "kind", "s")
            .agg(F.sum("a").alias("a"), F.sum("r").alias("r")))


def gains(wanted: DataFrame, counted: DataFrame) -> DataFrame:
    """``gram`` and ``gain``, the log ratio of its last character in units of 1 / ``UNIT``, of each ``gram`` of ``wanted``.

    ``wanted`` and ``counted`` are staged. Each order joins the one below on its shorter run: a key meets at most as
    many rows as there are characters.
    """
    few = keys_side(counted)
    below = None
    for k in range(ORDER + 1):
        t = wanted.select(F.substring("gram", ORDER + 1 - k, k + 1).alias("s")).distinct()
        for kind, size in (("g", k + 1), ("c", k)):
            part = few.where((F.col("k") == k) & (F.col("kind") == kind)).select(F.col("s").alias("_s"), *[F.col(x).alias(kind + x) for x in "ar"])
            t = t.join(part, F.substring("s", 1, size) == F.col("_s"), "left").drop("_s")
        if below is not None:
            t = t.join(keys_side(below), F.substring("s", 2, k) == F.col("_s")).drop("_s")
        for x in "ar":
            lower = F.lit(1.0 / SYMBOLS) if below is None else F.col(f"p{x}")
            n, m = (F.coalesce(f"{kind}{x}", F.lit(0)) for kind in "gc")
            t = t.withColumn(f"_{x}", (n + LEAN * lower) / (m + LEAN))
        below = stage(t.select(F.col("s").alias("_s"), F.col("_a").alias("pa"), F.col("_r").alias("pr")), "url-order")
    return below.select(F.col("_s").alias("gram"), F.round((F.log("pa") - F.log("pr")) * UNIT).cast("long").alias("gain"))


def exactly_scored(t: DataFrame, known: DataFrame, row: str = "_row") -> DataFrame:
    """``t`` with ``score`` from ``known``, the staged gains of all its grams; ``row`` tells its rows apart."""
    keys = t.columns
    side = keys_side(known)
    t = t.withColumn("_u", _folded(F.col("url")))
    score = F.sum(F.col("gain") * F.col("n")) / UNIT / F.sum("n")
    runs = _runs(t).withColumn("n", F.lit(1).cast("long"))
    if known.count() <= joins.BROADCAST_ROWS:
        # the characters of a URL are rows of one task: their sum is complete before the exchange
        some = runs.join(side, "gram").groupBy(*keys).agg(score.alias("score"))
        return some.unionByName(t.where(F.length("_u") <= ORDER).select(*keys, F.lit(0.0).alias("score")))
    # a run that many URLs share is a hot key of the merge, which Spark splits
    found = runs.groupBy(row, "gram").agg(F.sum("n").alias("n")).join(side, "gram").groupBy(row).agg(score.alias("score"))
    return t.select(*keys).join(found.hint("merge"), row, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, key: str = "page_id", url: str = "url",
          folds: int = 5) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every row.

    One labelled URL in ``folds`` (by its checksum) is kept from the counts and calibrates the threshold: the middle
    between the accepted URLs' fifth percentile and the rejected ones' ninety-fifth, 0 where a class is empty.
    """
    t = with_row(pages.select(F.col(key), F.col(url).alias("url")), "_row")
    t = t.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    t = t.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    t = t.select("_row", key, "url", "host", "path", F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("_given"))
    labelled = t.where(F.col("_given").isNotNull()).select("_row", "url", (F.col("_given") == "allow").alias("accepted"))
    held = F.pmod(F.crc32(F.col("url")), F.lit(folds)) == 0
    wanted = stage(_runs(t.select(_folded(F.col("url")).alias("_u"))).select("gram").distinct(), "url-grams")
    known = stage(gains(wanted, stage(gram_counts(labelled.where(~held)), "url-counts")), "url-gains")
    cut = exactly_scored(labelled.where(held), known).agg(F.coalesce(
        (F.percentile_approx(F.when(F.col("accepted"), F.col("score")), 0.05)
         + F.percentile_approx(F.when(~F.col("accepted"), F.col("score")), 0.95)) / 2, F.lit(0.0)).alias("cut"))
    passed = (F.length(F.coalesce("url", F.lit(""))) > 0) & (F.col("score") >= cut.scalar())
    return exactly_scored(t, known).select(
        key, "host", "path", "rule",
        F.coalesce("_given", F.when(passed, "allow").otherwise("block")).alias("verdict"), "score")
