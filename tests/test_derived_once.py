"""Queries that read a panel several times derive it from the tables once."""

import contextlib
import io

from longpanel.plans.catalog import load

QUERIES = load().queries


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def scans(text, table="lineitem"):
    return sum("Scan parquet" in line and f"{table}.parquet" in line for line in text.splitlines())


def test_adjust_as_of(spark, sf_dir):
    assert scans(plan(QUERIES["adjust_as_of"](spark, sf_dir))) == 0


def test_screen_ledger(spark, sf_dir, monkeypatch):
    from longpanel.operators import ledger
    from longpanel.plans.catalog import screening

    seen, propose = [], ledger.FactorLedger.propose
    monkeypatch.setattr(ledger.FactorLedger, "propose", lambda s, df, *a, **k: (seen.append(plan(df)), propose(s, df, *a, **k))[1])
    monkeypatch.setattr(screening, "_LEDGERS", {})
    screening._ledger(spark, sf_dir)
    assert len(seen) == 5 and not any(scans(t) or "Window" in t for t in seen)


def test_evaluation(spark, sf_dir):
    # the curve is read twice, each with its stamps
    assert scans(plan(QUERIES["eval_half_life"](spark, sf_dir))) <= 4
    assert scans(plan(QUERIES["eval_factor_ranking"](spark, sf_dir))) == 0


def test_rank_and_ties_share_a_sort(spark):
    from longpanel.functions.ordered import with_rank

    df = spark.range(9).selectExpr("id % 2 k", "if(id = 4, null, double(id % 3)) v")
    out = with_rank(df, ["k"], "v", "r")
    assert plan(out).count("+- Sort") <= 1
    assert sorted((r["k"], r["v"], r["r"]) for r in out.where("v is not null").collect()) == [
        (0, 0.0, 1.5), (0, 0.0, 1.5), (0, 2.0, 3.5), (0, 2.0, 3.5), (1, 0.0, 1.0), (1, 1.0, 2.5), (1, 1.0, 2.5), (1, 2.0, 4.0)]


def test_all_features(spark, sf_dir):
    for name in ("study_ic_all_features", "study_correlation_all_features"):
        assert scans(plan(QUERIES[name](spark, sf_dir))) == 0


def test_book_parts_go_to_their_symbol_once(spark, sf_dir):
    from longpanel.operators.book import book_snapshots
    from longpanel.sources.panels import order_events

    text = plan(book_snapshots(order_events(spark, sf_dir), 3600 * 10**9))
    assert text.count("REPARTITION_BY_COL") == 1 and "LeftOuter" not in text


class Stop(Exception):
    pass


def caught(monkeypatch, owner, name, run):
    """The plan of the frame that a step was given; the run ends there."""
    seen = []

    def stop(*args, **kwargs):
        seen.extend(plan(a) for a in args if hasattr(a, "explain"))
        raise Stop

    monkeypatch.setattr(owner, name, stop)
    try:
        run()
    except Stop:
        pass
    return seen


def test_walk_forward_splits_what_is_written(spark, sf_dir, monkeypatch):
    from longpanel.operators.validate import PurgedWalkForward

    seen = caught(monkeypatch, PurgedWalkForward, "split", lambda: QUERIES["model_walk_forward_linear"](spark, sf_dir))
    assert seen and not any(scans(t) for t in seen)


def test_daily_study_reads_a_written_panel(spark, sf_dir, monkeypatch):
    from longpanel.operators import masks

    seen = caught(monkeypatch, masks, "build_masks", lambda: QUERIES["study_daily_performance"](spark, sf_dir))
    assert seen and not any(scans(t) for t in seen)
