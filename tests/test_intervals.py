"""Interval joins against brute force: every kind of line, hot keys and nodes, NULLs, open and empty intervals."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from longpanel.operators import intervals as I
from longpanel.operators import universe as U

DAY = dt.date(2020, 1, 1)


def case(seed, kind, keys=4, n=300):
    """Points ``(k, x, i)`` and intervals ``(k, s, e, j)``; a third of each on one key and one place."""
    r = random.Random(seed)

    def place(v):
        if v is None:
            return None
        if kind == "date":
            return DAY + dt.timedelta(days=v)
        return dt.datetime(2020, 1, 1) + dt.timedelta(seconds=v * 1800.25) if kind.startswith("timestamp") else v

    key = lambda: None if r.random() < 0.02 else 0 if r.random() < 0.33 else r.randrange(keys)
    points = [(key(), place(None if r.random() < 0.02 else 50 if r.random() < 0.33 else r.randrange(200)), i) for i in range(n)]
    spans = []
    for j in range(n):
        s = r.randrange(-20, 210)
        e = None if r.random() < 0.1 else s + r.choice([-3, 0, 1, 2, 10, 100, 400])
        spans.append((key(), None if r.random() < 0.02 else place(s), place(e), j))
    return points + points[:5], spans + spans[:5]


def frames(spark, points, spans, kind):
    return (spark.createDataFrame(points, f"k int, x {kind}, i int").repartition(3),
            spark.createDataFrame(spans, f"k int, s {kind}, e {kind}, j int").repartition(3))


def pairs(points, spans, keyed):
    return sorted((i, j) for k, x, i in points for q, s, e, j in spans
                  if x is not None and s is not None and s <= x and (e is None or x < e) and (not keyed or (k is not None and k == q)))


@pytest.mark.parametrize("kind", ["int", "date", "timestamp", "timestamp_ntz", "double"])
@pytest.mark.parametrize("keyed", [False, True])
def test_pairs_against_brute_force(spark, kind, keyed):
    points, spans = case(1, kind)
    if kind == "double":
        points, spans = [(k, x if x is None else float(x), i) for k, x, i in points], [
            (k, s if s is None else s - 0.5, e if e is None else e - 0.5, j) for k, s, e, j in spans]
    p, s = frames(spark, points, spans, kind)
    by = ["k"] if keyed else []
    s = s if keyed else s.drop("k")
    want = pairs(points, spans, keyed)
    for options in ({}, {"leaves": 1}, {"leaves": 16}, {"leaves": 64, "pairs": 500}) if kind == "date" else ({"leaves": 32},):
        got = I.interval_join(p, s, "x", "s", "e", by, **options)
        assert sorted((r.i, r.j) for r in got.collect()) == want, options


def test_a_hot_node_is_dealt(spark):
    p = spark.range(2000).select(F.lit(7).alias("x"), F.lit(1).alias("i"))
    s = spark.range(50).select(F.lit(0).alias("s"), F.lit(None).cast("int").alias("e"), F.col("id").alias("j"))
    out = I.interval_join(p, s, "x", "s", "e", leaves=8, pairs=5_000)
    assert out.count() == 100_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "_iv_part" in plan


def test_long_intervals_do_not_multiply_by_leaves(spark):
    s = spark.range(1000).select(F.lit(0).alias("a"), F.lit(1023).alias("b"))
    assert s.select(F.max(F.size(I._cover(F.col("a"), F.col("b"), 10)))).first()[0] <= 22
    p = spark.range(1024).select(F.col("id").cast("int").alias("leaf"))
    met = p.crossJoin(F.broadcast(s.limit(1))).select(F.size(F.array_intersect(I._above(F.col("leaf"), 10), I._cover(F.col("a"), F.col("b"), 10))).alias("n"))
    assert met.agg(F.min("n"), F.max("n")).first() == (1, 1)


def test_merged_and_covered(spark, hot):
    points, spans = case(3, "date")
    p, s = frames(spark, points, spans, "date")
    for keyed in (True, False):
        by = ["k"] if keyed else []
        inside = {i for i, _ in pairs(points, spans, keyed)}
        want = sorted(i for _, _, i in points if i in inside)
        for _ in range(2):
            got = I.covered(p, s if keyed else s.drop("k"), "x", "s", "e", by, leaves=8)
            assert sorted(r.i for r in got.collect()) == want
        with hot:
            assert sorted(r.i for r in I.covered(p, s, "x", "s", "e", by).collect()) == want
    m = I.merged(spark.createDataFrame([(1, 5), (5, 7), (9, None), (20, 30), (8, 8)], "s int, e int"), "s", "e").collect()
    assert sorted(map(tuple, m)) == [(1, 7), (9, None)]


def test_empty_sides_and_clashing_names(spark):
    p = spark.createDataFrame([(1, 2)], "k int, x int")
    s = spark.createDataFrame([], "k int, s int, e int")
    assert I.interval_join(p, s, "x", "s", "e", ["k"]).columns == ["k", "x", "s", "e"]
    assert I.interval_join(p, s, "x", "s", "e", ["k"]).count() == 0
    assert I.interval_join(p.limit(0), s, "x", "s", "e", ["k"], leaves=4).count() == 0
    with pytest.raises(ValueError):
        I.interval_join(p, s, "x", "s", "e")


def test_members_over_dates_and_many_spells(spark):
    r = random.Random(5)
    rows = []
    for k in range(400):
        a = r.randrange(900)
        rows.append((r.choice("AB"), "X" if k % 3 == 0 else f"S{r.randrange(9)}", DAY + dt.timedelta(a), DAY + dt.timedelta(a + r.randrange(1, 90)) if r.random() < 0.9 else None))
    m = spark.createDataFrame(rows, "index_code string, symbol string, start_date date, end_date date")
    days = [DAY + dt.timedelta(i) for i in range(0, 1000, 3)]
    got = U.members_over(spark.createDataFrame([(d,) for d in days], "date date"), m)
    want = sorted((d, c, s) for d in days for c, s, a, b in rows if a <= d and (b is None or d < b))
    assert sorted(map(tuple, got.select("date", "index_code", "symbol").collect())) == want
    panel = spark.createDataFrame([(dt.datetime.combine(d, dt.time(15)), s) for d in days for s in ("X", "S1", "gone")], "ts timestamp, symbol string")
    got = U.membership_panel(panel, m).collect()
    assert sorted((x.ts.date(), x.index_code, x.symbol) for x in got) == [w for w in want if w[2] in ("X", "S1")]
    inside = {(d, s) for d, c, s in want if c == "A"}
    got = U.universe(panel, "A", membership=m).collect()
    assert sorted((x.ts.date(), x.symbol) for x in got) == sorted(x for x in inside if x[1] in ("X", "S1"))


def test_counts_of_open_intervals_write_no_pairs(spark, hot, monkeypatch):
    import longpanel.operators.intervals as I

    monkeypatch.setattr(I, "interval_join", None)
    points = spark.sql("SELECT CASE WHEN id < 40 THEN id END AS x FROM range(45) UNION ALL SELECT 7")
    spells = spark.range(300).selectExpr("CASE WHEN id % 11 > 0 THEN id % 7 END AS k", "id % 31 AS a", "CASE WHEN id % 13 > 0 THEN id % 31 + id % 5 - 1 END AS b")
    spells = spells.union(spark.sql("SELECT 1, CAST(NULL AS long), 5"))
    t = [r for r in spells.collect() if r.a is not None]
    want = []
    for x in range(40):
        held = [r for r in t if r.a <= x and (r.b is None or x < r.b)]
        if held:
            want.append((x, len(held), len({r.k for r in held} - {None})))
    assert sorted(tuple(r) for r in I.open_counts(points, spells, "x", "a", "b", ["k"]).collect()) == want
    with hot:
        assert sorted(tuple(r) for r in I.open_counts(points, spells, "x", "a", "b", ["k"]).collect()) == want
