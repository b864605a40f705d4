"""A training corpus from ``documents`` in five stages, each a table that the next one reads.

Rows of a stage are told apart by their file and their place in it, as keys may be missing or repeat: equal keys, equal
texts and repeated rows are rows of their own, and of a group of linked rows the one of smallest ``doc_id`` stays, of
equal ids the one that stands first in the files. Empty tables pass through every stage; NULL and empty texts leave at the
first, which rejects what has no letter. Very long texts are read whole by one task each. Other columns of documents may
have any names and are carried along; names that the stages add for themselves are made up anew each time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longpanel.llm import decontaminate, language_id, mixing, signature_trees, token_files
from longpanel.llm.joins import keys_side
from longpanel.llm.rows import with_row
from longpanel.llm.scratch import folder, stage

END_ID = 2
#: Rows of an Arrow batch: documents are long, and two batches are in memory on both sides of a worker.
BATCH_ROWS = "1000"


def _fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept."""
    _small_batches(spark)
    return language_id.accepted(docs, *language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest ``doc_id``; documents without words stay."""
    _small_batches(spark)
    name = _fresh("row")
    t = with_row(docs, name)
    own = t.select(F.col(name).alias("row"), "doc_id", "text")
    groups = stage(signature_trees.linked(own, key="row").select("row", "component_id"), "groups")
    many = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    several = stage(groups.join(keys_side(stage(many, "many")), "component_id"), "several")
    ids = own.select("row", "doc_id").join(keys_side(several), "row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    kept = stage(first.select(F.col("first.row").alias("row")), "kept")
    gone = stage(several.select("row").join(keys_side(kept), "row", "left_anti").withColumnRenamed("row", name), "gone")
    return t.join(keys_side(gone), name, "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    _small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes its words: the whole part of the ratio, one more by a hashed draw."""
    row, copy = _fresh("row"), _fresh("copy")
    t = with_row(docs, row)
    taken = mixing.mix(t.select(F.col(row).alias("row"), "doc_id", "text", "source"), row=F.col("row")).where("taken > 0")
    draw = F.pmod(F.xxhash64("row", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = taken.select(F.col("row").alias(row), F.floor(F.col("taken") / F.col("size") + draw).cast("int").alias(copy))
    t = t.join(keys_side(stage(copies.where(F.col(copy) > 0), "copies")), row)
    return t.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of the corpus, read back: where each document stands, its length and checksum."""
    import public_tokenizers

    _small_batches(spark)
    found = token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokens),
]

#: SQL cannot state the language models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = folder(spark, "pipeline")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
