"""Queries over events whose first numbers are of the kinds that only some tables hold."""

import shutil
from datetime import datetime, timedelta

import pytest
from conftest import rows
from test_catalog import QUERIES, SQL, connect


@pytest.fixture
def first_events(spark, sf_dir, tmp_path):
    """The smallest tables, with few events: 0 is an add, 1 a cancel in Shenzhen."""
    folder = tmp_path / "sf"
    shutil.copytree(sf_dir, folder)
    start = datetime(2024, 1, 1, 9, 30)
    kinds = ["view", "click", "purchase", "view", "click", "purchase"]
    events = [(i, start + timedelta(seconds=i * i), 7, k, 2.0, '{"k": 3}') for i, k in enumerate(kinds)]
    (folder / "events.parquet").chmod(0o644)
    connect(folder).execute("create table e (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)"
                            ).executemany("insert into e values (?, ?, ?, ?, ?, ?)", events).execute(
        f"copy e to '{folder}/events.parquet' (format parquet)")
    return str(folder)


def both(spark, folder, name):
    got = QUERIES[name](spark, folder)
    want = connect(folder).execute(SQL[name])
    cols = [c[0] for c in want.description]
    return rows(got.select(*cols)), sorted((dict(zip(cols, r)) for r in want.fetchall()), key=lambda r: tuple((r[c] is None, r[c]) for c in cols))


def test_a_cancel_of_order_zero_has_key_zero(spark, first_events):
    got, want = both(spark, first_events, "book_order_key_events")
    assert got == want and [r["key"] for r in got if r["seq_id"] == 1] == [0]


def test_the_window_of_holes_counts_records_without_a_number(spark, first_events):
    # trades 1 and 2 come before any order with a number: they are in the window only because of order 0
    got, want = both(spark, first_events, "tick_hole_counts")
    assert got == want and [r["trade_n"] for r in got] == [2]
