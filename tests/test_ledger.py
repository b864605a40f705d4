"""The stored factor pool: pair moments against pandas, steps that persist, competing writers, every verdict."""

import datetime as dt
import random

import pandas as pd
import pytest

from longpanel.operators.ledger import FactorLedger, correlations, pair_moments
from longpanel.sources.store import CommitConflict


def panel(spark, seed=1, weeks=12, names=40):
    r = random.Random(seed)
    rows = []
    for w in range(weeks):
        for s in range(names):
            a, b = r.gauss(0, 1), r.gauss(0, 1)
            rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(weeks=w), f"S{s}", None if r.random() < 0.1 else a, 2 * a + 1, a + 0.9 * b,
                         float("nan") if r.random() < 0.1 else float(round(r.gauss(0, 1))), None))
    return spark.createDataFrame(rows, "ts timestamp_ntz, symbol string, a double, twin double, near double, other double, empty double")


def brute(df, x, y, method, least=20):
    p = df.toPandas()
    out = []
    for _, g in p.groupby("ts"):
        g = g[[x, y]].dropna()
        if len(g) >= least:
            c = g.rank().corr().iloc[0, 1] if method == "spearman" else g.corr().iloc[0, 1]
            if c == c:
                out.append(c)
    return sum(out) / len(out) if out else None, len(out)


@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_pair_moments(spark, hot, method):
    df = panel(spark)
    others = ["twin", "near", "other", "empty"]

    def check():
        got = {r.other: r for r in correlations(pair_moments(df, "a", others, method=method), ["other"]).collect()}
        assert set(got) == {"twin", "near", "other"}
        for o in got:
            rho, n = brute(df, "a", o, method)
            assert abs(got[o].rho - rho) < 1e-12 and got[o].n_ts == n

    check()
    with hot:
        check()


def test_steps_persist_and_every_verdict_is_given(spark, tmp_path):
    df = panel(spark)
    path = str(tmp_path / "pool")
    ledger = FactorLedger(spark, path, threshold=0.5, reject_above=0.95)
    assert ledger.factors() == [] and ledger.log().count() == 0
    assert ledger.propose(df, "a").columns == df.columns
    ledger.propose(df, "twin")
    again = FactorLedger(spark, path, threshold=0.5, reject_above=0.95)
    out = again.propose(df, "near")
    again.propose(out, "other")
    again.propose(df, "empty")
    log = [(r.step, r.factor, r.verdict, r.tested_against, r.most_correlated) for r in again.log().orderBy("step").collect()]
    assert log == [(1, "a", "admit", "", None), (2, "twin", "reject", "a", "a"), (3, "near", "orthogonalize", "a", "a"),
                   (4, "other", "admit", "a, near", log[3][4]), (5, "empty", "reject", "a, near, other", None)]
    assert again.factors() == ["a", "near", "other"] and again.factors(step=2) == ["a"] and ledger.factors() == again.factors()
    assert abs(brute(out, "near", "a", "pearson")[0]) < 1e-6
    rho = {(r.f1, r.f2): r.rho for r in again.correlation().collect()}
    assert abs(rho["twin", "a"] - brute(df, "twin", "a", "spearman")[0]) < 1e-12
    with pytest.raises(ValueError):
        again.propose(df, "a")
    with pytest.raises(ValueError):
        again.propose_all(df, ["x", "x"])


def test_a_step_is_made_once(spark, tmp_path, monkeypatch):
    df = panel(spark)
    one, two = (FactorLedger(spark, str(tmp_path / "pool")) for _ in range(2))
    write = type(one.entries)._measure

    def meanwhile(files, fields):
        monkeypatch.setattr(type(one.entries), "_measure", staticmethod(write))
        two.propose(df, "twin")
        return write(files, fields)

    monkeypatch.setattr(type(one.entries), "_measure", staticmethod(meanwhile))
    with pytest.raises(CommitConflict):
        one.propose(df, "a")
    assert one.factors() == ["twin"]
