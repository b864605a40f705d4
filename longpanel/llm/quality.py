"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Input: a table with a text column. NULL and empty texts have no words and fail the base rule. Ties and repeated rows
are judged one by one; other columns are ignored. Nothing is shuffled: each text is judged on its own row.

A repeated window is found by a 64-bit hash of its eight words within one text; two different windows of a text share
a hash with a chance below 1e-10 for texts of 50,000 words.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import word_array

WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a", "al", "als", "an", "and", "are", "as", "at", "au", "auf", "aus", "avec", "be", "by", "con", "dans", "das",
    "de", "del", "dem", "den", "der", "des", "die", "du", "ein", "eine", "el", "en", "es", "est", "et", "for", "from",
    "für", "have", "he", "in", "is", "ist", "it", "la", "las", "le", "les", "lo", "los", "mit", "nicht", "no", "not",
    "of", "on", "or", "par", "para", "pas", "por", "pour", "que", "qui", "se", "sich", "su", "sur", "that", "the",
    "this", "to", "un", "una", "und", "une", "von", "was", "with", "y", "zu",
)


class Rule(NamedTuple):
    """``low <= numerator / denominator <= high`` where the text has at least ``least`` words.

    Compared as a product, so that nothing is divided; an open end is ``None``.
    """

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None
    least: int = 0


RULES = (
    Rule("word length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("exclamations", "n_exclaims", "n_words", None, 0.25),
    Rule("letters", "n_letters", "word_chars", 0.6, None),
    Rule("stop words", "n_stop_words", "n_words", 0.01, None, 100),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("stutters", "n_stutters", "n_words", None, 0.3),
)


def metrics(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the counts the rules read, as long columns; a NULL text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", word_array(F.col(text)))
    out = out.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    # windows read single elements: slicing would copy the whole array for every window
    runs = F.when(n >= window, F.transform(
        F.sequence(F.lit(0), n - window),
        lambda i: F.xxhash64(*[F.col("_hash")[i + k] for k in range(window)])))
    out = out.withColumn("_runs", runs)
    out = out.withColumn("_again", F.size(F.array_distinct("_runs")) < F.size("_runs"))
    # only a text that repeats a window sorts its windows
    out = out.withColumn("_sorted", F.when(F.col("_again"), F.array_sort(
        F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    last = F.size("_sorted") - 1
    same = F.filter(F.sequence(F.lit(0), last), lambda k: (
        F.when(k > 0, F.col("_sorted")[k - 1]["h"] == F.col("_sorted")[k]["h"]).otherwise(False)
        | F.when(k < last, F.col("_sorted")[k + 1]["h"] == F.col("_sorted")[k]["h"]).otherwise(False)))
    out = out.withColumn("_at", F.when(F.col("_again"), F.array_sort(
        F.transform(same, lambda k: F.col("_sorted")[k]["i"]))))
    covered = F.aggregate(
        "_at", F.struct(F.lit(0).alias("n"), F.lit(-window).alias("p")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["p"])).alias("n"), p.alias("p")),
        lambda a: a["n"].cast("long"))
    return out.select(
        *[F.col(c) for c in docs.columns],
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclaims"),
        F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_hash", lambda h, i: F.when(i > 0, F.col("_hash")[i - 1] == h).otherwise(False)))
        .cast("long").alias("n_stutters"))


def compiled(rules: Sequence[Rule] = RULES) -> Column:
    """The threshold table as one boolean expression over the metric columns."""
    out = F.lit(True)
    for r in rules:
        top, bottom = F.col(r.numerator), F.col(r.denominator)
        fits = F.lit(True)
        if r.low is not None:
            fits = fits & (top >= bottom * r.low)
        if r.high is not None:
            fits = fits & (top <= bottom * r.high)
        out = out & (fits if not r.least else ((F.col("n_words") < r.least) | fits))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with metrics, ``base_failed`` and ``kept``."""
    keep = docs.columns
    own = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_letters",
           "n_stop_words", "n_stutters", "base_failed", "kept", "_words", "_lines", "_hash", "_runs", "_again", "_sorted", "_at"}
    if text in own:
        docs, text = docs.withColumnRenamed(text, "_text"), "_text"
        keep = docs.columns
    docs = docs.select(*[c for c in keep if c not in own])
    out = metrics(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & compiled(rules))
