"""Counts and earliest starts of open intervals against a plain walk, without a pair in the plan."""

import datetime as dt
import random

from longpanel.operators.intervals import open_intervals

D0 = dt.date(2024, 1, 1)


def test_counts_and_oldest(spark, hot):
    r = random.Random(4)
    day = lambda n: D0 + dt.timedelta(days=n)
    spells = [(r.choice("ABC"), day(a), None if r.random() < 0.05 else day(a + r.randrange(-2, 12))) for a in (r.randrange(60) for _ in range(200))]
    spells += [(None, day(1), day(9)), ("A", None, day(9)), ("D", day(3), None)]
    points = [(s, day(n), n % 3) for s in "ABCDE" for n in range(-3, 75)] + [("A", day(5), 7), ("A", None, 1), (None, day(2), 1)]
    p = spark.createDataFrame(points, "symbol string, day date, extra int")
    i = spark.createDataFrame(spells, "symbol string, a date, b date")
    want = []
    for s, x, e in points:
        held = [a for k, a, b in spells if x and s and k == s and a and a <= x and (b is None or x < b)]
        if held:
            want.append((s, x, e, len(held), min(held)))
    plain = open_intervals(p, i, "day", "a", "b", ["symbol"])
    assert sorted(map(tuple, plain.collect())) == sorted(want)
    # one side only: no join of points and intervals
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    with hot:
        assert sorted(map(tuple, open_intervals(p, i, "day", "a", "b", ["symbol"]).collect())) == sorted(want)
