"""Commits: failed and competing rewrites, old versions, schemas that change, files that go missing."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from longpanel.sources.store import CommitConflict, NoCommit, Store


def frame(spark, dates, value, extra=""):
    rows = [(d, f"S{i}", float(value + i)) for d in dates for i in range(4)]
    df = spark.createDataFrame(rows, "date string, symbol string, close double")
    return df.selectExpr("*", *extra.split(",")) if extra else df


def state(df):
    return sorted((r.date, r.symbol, r.close) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "t"))


def test_rewrites_replace_their_partitions_only(spark, store):
    with pytest.raises(NoCommit):
        store.read()
    assert store.write(frame(spark, ["20200101", "20200102"], 0)) == 1
    assert store.write(frame(spark, ["20200102", "20200103"], 10), files_per_date=3) == 2
    want = state(frame(spark, ["20200101"], 0).union(frame(spark, ["20200102", "20200103"], 10)))
    assert state(store.read()) == want
    assert state(store.read(version=1)) == state(frame(spark, ["20200101", "20200102"], 0))
    assert [r.date for r in store.read(["close"], start="20200102", end="20200102").select("date").distinct().collect()] == ["20200102"]
    assert store.write(frame(spark, ["20200105"], 5), replace=True) == 3
    assert state(store.read()) == state(frame(spark, ["20200105"], 5))
    assert store.read(start="20210101").count() == 0


def test_a_failed_rewrite_shows_the_old_state(spark, store):
    store.write(frame(spark, ["20200101", "20200102"], 0))
    before = state(store.read())
    running = store.read()
    bad = frame(spark, ["20200101", "20200102"], 50).withColumn(
        "close", F.when(F.col("symbol") == "S3", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="lost"):
        store.write(bad)
    assert state(store.read()) == before and store.versions() == [1]
    store.write(frame(spark, ["20200101"], 99))
    assert state(running) == before and state(store.read()) != before


def test_competing_writers(spark, store, monkeypatch):
    store.write(frame(spark, ["20200101"], 0))
    other = Store(spark, store.path)
    measure = Store._measure

    def meanwhile(files, fields):
        monkeypatch.setattr(Store, "_measure", staticmethod(measure))
        other.write(frame(spark, ["20200101"], 7))
        return measure(files, fields)

    monkeypatch.setattr(Store, "_measure", staticmethod(meanwhile))
    with pytest.raises(CommitConflict):
        store.write(frame(spark, ["20200101"], 3))
    assert state(store.read()) == state(frame(spark, ["20200101"], 7)) and store.versions() == [1, 2]


def test_schemas_change_and_reads_are_planned_from_the_manifest(spark, store):
    store.write(frame(spark, ["20200101", "20200102"], 0, "1 as n"))
    store.write(frame(spark, ["20200103"], 1, "2L as n, 'x' as tag"))
    store.write(frame(spark, ["20200105"], 2))
    store.write(frame(spark, ["20200104"], 3, "3L as n, 'y' as tag"))
    got = sorted((r.date, r.column, r.change, r.before, r.after) for r in store.drift().collect())
    assert got == [("20200103", "n", "retyped", "int", "bigint"), ("20200103", "tag", "added", None, "string"),
                   ("20200105", "n", "removed", "bigint", None), ("20200105", "tag", "removed", "string", None)]
    assert store.schema()["n"].dataType.simpleString() == "bigint"
    rows = store.read(["n", "tag", "symbol"]).where("symbol = 'S1'").collect()
    assert sorted((r.date, r.n, r.tag) for r in rows) == [("20200101", 1, None), ("20200102", 1, None), ("20200103", 2, "x"),
                                                          ("20200104", 3, "y"), ("20200105", None, None)]
    with pytest.raises(KeyError):
        store.read(["open"])
    with pytest.raises(ValueError):
        store.write(frame(spark, ["20200101"], 0, "1 as commit"))


def test_damage_is_found(spark, store):
    store.write(frame(spark, ["20200101", "20200102"], 0))
    store.write(frame(spark, ["20200103"], 0, "1 as n"))
    assert store.damaged().count() == 0
    for f in glob.glob(f"{store.path}/data/commit=*/date=20200102/*.parquet"):
        os.remove(f)
    assert [tuple(r) for r in store.damaged().collect()] == [("20200102", 4, 0)]


def test_an_empty_write_commits_nothing_new(spark, store):
    store.write(frame(spark, ["20200101"], 0))
    store.write(frame(spark, ["20200101"], 0).limit(0))
    assert store.read().count() == 4
