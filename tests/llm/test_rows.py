"""Row numbers are the same in every job, however Spark splits the files."""

import pytest
from pyspark.sql import functions as F

from longpanel.llm import bwt_dedup, repeats, rows

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def table(spark, tmp_path):
    """Several files of several row groups, with repeated and missing keys."""
    path = str(tmp_path / "with space" / "docs.parquet")
    t = spark.range(20_000).select((F.when(F.col("id") % 7 != 0, F.col("id") % 500)).alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    t.repartition(5).write.option("parquet.block.size", 32_768).parquet(path)
    return spark.read.parquet(path)


def numbers(t, name="row"):
    got = {r["text"]: r[name] for r in t.select("text", name).collect()}
    assert len(got) == len(set(got.values())) == 20_000
    return got


def test_numbers_hold_when_splits_change(spark, table):
    t = repeats.numbered(table, "doc_id")
    default = spark.conf.get(SPLIT)
    found = []
    try:
        for size in (default, "40k", "150k"):
            spark.conf.set(SPLIT, size)
            # the plan of a frame is made once: the same steps are planned anew for each size of splits
            found.append((t.select("*").rdd.getNumPartitions(), numbers(t.select("*"))))
    finally:
        spark.conf.set(SPLIT, default)
    assert len({n for n, _ in found}) > 1
    assert all(x == found[0][1] for _, x in found)


def test_frames_that_are_no_single_scan_are_written(spark, table):
    both = table.where("doc_id is null").unionByName(table.where("doc_id is not null"))
    for t in (both, table.repartition(3), table.join(spark.range(2), F.col("id") == 0, "left").drop("id"), table.withColumn("_metadata", F.lit(1))):
        got = rows.with_row(t, "row")
        assert numbers(got) == numbers(got.repartition(4)) and got.columns == [*t.columns, "row"]
    again = rows.with_row(table.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))), "row")
    assert again.select("row").distinct().count() == 40_000
    assert rows.with_row(table.where("false"), "row").count() == 0


def test_spans_are_cut_from_their_own_texts(spark, tmp_path, monkeypatch):
    """Splits that change between the passes of one query leave the result as it is."""
    passage = " ".join(f"shared{i}" for i in range(40))
    path = str(tmp_path / "docs.parquet")
    t = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 512),
                                F.when(F.col("id") % 3 == 0, F.lit(passage)), F.sha2((-F.col("id")).cast("string"), 512)).alias("text"))
    t.repartition(4).write.option("parquet.block.size", 4096).parquet(path)
    docs = spark.read.parquet(path)
    want = sorted(map(tuple, bwt_dedup.digests(docs).collect()))
    default = spark.conf.get(SPLIT)
    real = repeats.stage

    def moved(df, name):
        out = real(df, name)
        spark.conf.set(SPLIT, "20k" if name == "stretches" else default)
        return out

    monkeypatch.setattr(repeats, "stage", moved)
    try:
        first = bwt_dedup.digests(docs)
        spark.conf.set(SPLIT, "20k")
        got = sorted(map(tuple, first.collect()))
    finally:
        spark.conf.set(SPLIT, default)
    assert got == want and sum(r[2] > 0 for r in got) > 100
