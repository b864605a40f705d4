"""Queries of the training-data operators over whole tables, with SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return deco


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_add("op2_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_add("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_read(spark, sf_dir, "pages"))


def _quality_sql() -> str:
    """The counts by their definitions, the verdict from the same threshold table."""
    from .quality import RULES, STOP_WORDS

    rules = []
    for r in RULES:
        sides = [f"{r.numerator} >= {r.low} * {r.denominator}"] * (r.low is not None) + [
            f"{r.numerator} <= {r.high} * {r.denominator}"] * (r.high is not None)
        rules.append(f"(n_words < {r.least} OR ({' AND '.join(sides)}))")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
runs AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, r) AS n FROM runs) WHERE n > 1),
covered AS (SELECT doc_id, sum(least(8, i - p)) AS n FROM (
  SELECT doc_id, i, lag(i, 1, i - 8) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM again) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(regexp_extract_all(t, '!')) AS BIGINT) AS n_exclaims,
  CAST(length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS BIGINT) AS n_letters,
  CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
  CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_stutters
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(rules)} AS kept, n_lines, n_exclaims, n_letters, n_stop_words FROM b"""


@_add("op7_quality_rules", _quality_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_exclaims", "n_letters", "n_stop_words")


@_add("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, held_out, identify

    docs = _read(spark, sf_dir, "documents")
    found = identify(docs, *fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits", "accepted")


@_add("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import search

    return search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@_add("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import round_trip

    found = round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@_add("op4_html_wrappers")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_wrappers import main_text

    return main_text(_read(spark, sf_dir, "pages"))


@_add("op9_signature_trees")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .signature_trees import linked

    return linked(_read(spark, sf_dir, "documents"))


@_add("op5_bwt_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bwt_dedup import digests

    return digests(_read(spark, sf_dir, "documents"))


@_add("op8_automaton_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .automaton_dedup import digests

    return digests(_read(spark, sf_dir, "documents"))


_CRC = """CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS BIGINT)"""


@_add("op11_conversation_trie", rf"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS k FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, {_CRC.format('c')} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT cs.c, 0 AS own, k, role, text FROM cs JOIN t ON t.c = cs.c - cs.c % 20 AND k < h
  UNION ALL SELECT cs.c, 1, k, role, text FROM cs JOIN t ON t.c = cs.c AND k >= h),
l AS (SELECT cs.c, coalesce(v, []) AS v FROM cs LEFT JOIN (
  SELECT c, list(struct_pack(role := role, text := text) ORDER BY own, k) AS v FROM r GROUP BY c) x ON x.c = cs.c),
m AS (SELECT c, d, list_slice(v, 1, d) AS p, d = len(v) AS ends FROM (SELECT c, v, unnest(range(len(v) + 1)) AS d FROM l)),
n AS (SELECT p, d, min(c) AS c, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends) AS e FROM m GROUP BY p, d),
q AS (SELECT *, list_slice(p, 1, d - 1) AS up, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(list_filter(
  regexp_split_to_array(p[d].text, '[ 	-]+'), lambda x: x <> '')) END AS saved FROM n),
f AS (SELECT q.*, coalesce(x.n, 0) AS kids FROM q LEFT JOIN (SELECT up, d, count(*) AS n FROM q WHERE d > 0 GROUP BY up, d) x ON x.up = q.p AND x.d = q.d + 1),
s AS (SELECT a.p, a.d, sum(b.saved) AS saved, count(CASE WHEN b.kids = 0 THEN 1 END) AS leaves
  FROM f a JOIN f b ON b.d >= a.d AND list_slice(b.p, 1, a.d) = a.p GROUP BY a.p, a.d)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, CASE WHEN f.d > 0 THEN g.c END AS parent_conv_id, f.n AS n_convs, f.kids AS n_children,
  s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.e, '')) AS ends_sha256
FROM f JOIN s ON s.p = f.p AND s.d = f.d LEFT JOIN f g ON g.p = f.up AND g.d = f.d - 1""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import rebuilt_trie

    return rebuilt_trie(_read(spark, sf_dir, "conversations"))


@_add("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import digests

    return digests(_read(spark, sf_dir, "documents"))


@_add("op13_warc_salvage", """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_add("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)
