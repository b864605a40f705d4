"""What large studies put on disk: rows are not repeated a factor or a pair, and shuffle files go with the job that wrote them."""

import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows, same
from longpanel.functions.columns import SYMBOL, TS
from longpanel.functions.ordered import CLEANUP_CONF, annotate, durable, join_back, staged
from longpanel.operators import covariance as K
from longpanel.operators import evaluate as E
from longpanel.operators import features_daily as D
from longpanel.operators import masks as M
from longpanel.plans.catalog import load, studies
from longpanel.sources.panels import weekly_panel
from test_derived_once import plan
from test_pair_tiles import frame

QUERIES = load().queries


def shuffled(spark):
    """Shuffle files on this machine's disks."""
    at = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name for d in at for _, _, names in os.walk(d.getPath()) for name in names if name.startswith("shuffle_")}


def panel(spark):
    return spark.range(3000).selectExpr(
        "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(int(id % 5)) ts", "string(id div 5) symbol",
        "if(id % 11 = 0, null, double(xxhash64(id) % 50)) a", "if(id % 7 = 0, double('nan'), double(xxhash64(id, 1) % 9)) b",
        "if(id % 5 = 3, null, 1.0) c", "double(xxhash64(id, 2) % 40) y")


def test_factors_go_to_their_stamp_side_by_side(spark, hot):
    df = panel(spark)
    series = E.ic(df, ["a", "b", "c"], "y")
    text = plan(series)
    assert "Generate" not in text and text.count("Exchange hashpartitioning(ts") == 1
    with hot:
        other = E.ic(df, ["a", "b", "c"], "y")
        assert "FlatMapGroupsInArrow" not in plan(other)
        same(series, other, ["factor", TS], tol=1e-12)
    got = {(r["factor"], r["ts"].day): r for r in rows(series, "factor", TS)}
    assert len(got) == 14 and got["c", 1]["ic"] is None and got["a", 1]["n"] < 600


def test_what_is_written_leaves_no_shuffle_files(spark):
    df = spark.range(1000).selectExpr("id % 7 k", "id v").groupBy("k").count()
    before = shuffled(spark)
    df.write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before
    before = shuffled(spark)
    out = durable(df)
    for _ in range(100):  # they are removed behind the job's back
        if not shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffled(spark) - before and spark.conf.get(CLEANUP_CONF) == "false"
    assert out.count() == 7


def test_turnover_and_buckets_go_side_by_side(spark, hot, monkeypatch):
    df = panel(spark).where("not (symbol = '17' and ts < '2024-01-02')")
    # too few names with a value at the second stamp: the third is compared with the first
    df = df.withColumn("c", F.when((F.dayofmonth("ts") == 1) | (F.dayofmonth("ts") == 3), F.col("y")))
    cols = ["a", "b", "c"]
    for d in (df, df.unionByName(df.where("symbol < '2'").withColumn("a", F.col("a") + 1)),
              df.unionByName(df.where("symbol < '2'").withColumn("symbol", F.lit(None).cast("string")))):
        one, buckets = E.turnover(d, cols), E.bucketed(d, cols, "y", 4)
        with hot:
            same(one, E.turnover(d, cols), ["factor", TS], tol=1e-12)
            if d is df:  # rows with one key and value may fall into either bucket
                same(buckets, E.bucketed(d, cols, "y", 4), ["factor", TS, "bucket"], tol=1e-12)
    text = plan(E.turnover(df, cols))
    assert "Generate" not in text and text.count("Exchange hashpartitioning") == 2
    assert "Generate" not in plan(E.bucketed(df, cols, "y", 4))
    whole = E.factor_ranking(df, cols, "y")
    monkeypatch.setattr(E, "CELLS", 1)
    same(whole, E.factor_ranking(df, cols, "y"), ["factor"])


def test_masks_of_the_same_rows(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    cols = ["close", "vwap"]
    p = durable(p)
    same(M.masked(p, cols), M.apply_masks(p, M.build_masks(p), columns=cols), [SYMBOL, TS])
    assert "Join" not in plan(M.masked(p, cols)) and M.masked(p, cols).where("vwap is null").count() > 0


def test_a_staged_table_is_deleted(spark):
    with staged(spark.range(5).toDF("v")) as t:
        files = t.inputFiles()
        assert t.count() == 5 and all(os.path.exists("/" + f.removeprefix("file:///")) for f in files)
    assert not any(os.path.exists("/" + f.removeprefix("file:///")) for f in files)


def test_statistics_of_few_groups_are_broadcast(spark):
    df = annotate(spark.range(100).selectExpr("id % 3 k", "id v"), {"k": (40, 3)})
    out = join_back(df, df.groupBy("k").agg(F.sum("v").alias("s")), ["k"])
    assert "BroadcastHashJoin" in plan(out) and out.where("s is null").count() == 0


def test_study_in_groups_of_features(spark, sf_dir, monkeypatch):
    whole = QUERIES["study_ic_all_features"](spark, sf_dir)
    monkeypatch.setattr(studies, "CELLS", 1)
    groups = studies._groups(10**9)
    assert sorted(n for g in groups for n in g) == sorted(D.FEATURES) and max(map(len, groups)) == studies.FEWEST
    same(whole, QUERIES["study_ic_all_features"](spark, sf_dir), ["factor"])
    with pytest.raises(ValueError):
        D.compute_features(whole.selectExpr("1 ts", "1 symbol", *[f"1.0 {c}" for c in D.REQUIRED]), ["rev_5"], written_ranks=True)


def test_a_task_passes_over_the_tile_it_does_not_hold(spark, monkeypatch):
    p = frame(n=61, t=25)
    df = spark.createDataFrame(p)
    m = p.merge(p, on="ts").query("symbol_x <= symbol_y")
    want = {k: (len(g), (g.ret_x * g.ret_y).sum()) for k, g in m.groupby(["symbol_x", "symbol_y"])}
    monkeypatch.setattr(K, "ROW", 60)  # two symbols a row
    out = K.pair_moments(df, block=4, slice_len=7)
    text = plan(out)
    # rows come as they were sorted for the task: its own tile first, and no second sort or shuffle over them
    assert text.count("Exchange") == 1 and text.count("Sort ") == 1 and "_b" in text.split("Sort [")[1].split("]")[0]
    got = {(r.symbol_i, r.symbol_j): r for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k].n == n and abs(got[k].sij - s) < 1e-9 for k, (n, s) in want.items())
    # a panel is not dealt out more often than there are tiles
    assert K._tile(60_000, 361, 32, 100) == (7500, True) and K._tile(360_000, 361, 32, 100)[0] > 40_000
