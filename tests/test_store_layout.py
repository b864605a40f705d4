"""Datasets whose symbols are too many for a folder each, and stores that hold what was asked for."""

import os

from conftest import rows

from longpanel.plans.catalog import storage
from longpanel.sources import tables as S


def test_many_symbols_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MAX_FOLDERS", 50, raising=False)
    df = spark.range(3000).selectExpr("lpad(string(id), 6, '0') AS symbol", "date'2020-01-01' + int(id % 3) AS day", "double(id) AS close")
    df = df.selectExpr("symbol", "date_format(day, 'yyyyMMdd') AS date", "CAST(day AS timestamp_ntz) AS ts", "close")
    S.write_partitioned(df, f"{tmp_path}/actions", by_symbol=True)
    folders = [f for _, dirs, _ in os.walk(tmp_path) for f in dirs if f.startswith("symbol")]
    assert 0 < len(folders) <= 3 * 64
    root = S.DataRoot(spark, str(tmp_path))
    assert root.hive_keys("actions") == ("date", "symbol")
    back = root.read("actions")
    assert rows(back.select(*df.columns)) == rows(df)
    got = S.load_daily(back, symbols=["000007", "002999"], dates=["2020-01-02"])
    assert got.columns == ["ts", "symbol", "close"] and [r["symbol"] for r in rows(got)] == ["000007"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "symbol_bucket" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]


def test_a_query_writes_the_dataset_that_it_reads(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(storage, "_STORES", {})
    storage.registered(spark, sf_dir).collect()
    (root,) = storage._STORES.values()
    assert S.DataRoot(spark, root).available() == ["daily"]
    assert len(storage.discovery(spark, sf_dir).collect()) == 6
