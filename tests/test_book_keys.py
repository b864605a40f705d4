"""Order keys that are used again, and symbols on two channels."""

import pytest
from conftest import rows

from longpanel.operators.book import book_snapshots

SCHEMA = ("channel_id int, seq_id long, arrival_ts long, symbol string, exchange string, kind string, price double, "
          "qty long, side string, key long, buy_key long, sell_key long")
SLOT = 1_000


def event(seq, kind, price=0.0, qty=0, side="", key=0, channel=1, symbol="s", buy=0, sell=0):
    return (channel, seq, seq * SLOT + 1, symbol, "XSHG", kind, price, qty, side, key, buy, sell)


def book(spark, events):
    return rows(book_snapshots(spark.createDataFrame(events, SCHEMA), SLOT), "slot")


def test_a_key_added_again_replaces_its_order(spark):
    got = book(spark, [event(1, "add", 10.0, 5, "buy", key=7), event(2, "add", 11.0, 3, "buy", key=7), event(3, "add", 9.0, 1, "buy", key=8),
                       event(4, "cancel", key=7), event(5, "add", 20.0, 1, "sell", key=9)])
    state = [(r["best_bid"], r["bid_qty"], r["n_bid_orders"], r["unresolved"]) for r in got]
    assert state == [(10.0, 5, 1, 0), (11.0, 3, 1, 0), (11.0, 3, 2, 0), (9.0, 1, 1, 0), (9.0, 1, 1, 0)]


def test_decrements_go_to_the_order_alive(spark):
    got = book(spark, [event(1, "add", 10.0, 5, "buy", key=7), event(2, "trade", 10.0, 2, "sell", buy=7), event(3, "add", 10.5, 4, "buy", key=7),
                       event(4, "trade", 10.5, 1, "sell", buy=7), event(5, "cancel", key=99), event(6, "add", 1.0, 1, "buy", key=3)])
    assert [(r["best_bid"], r["bid_qty"], r["unresolved"]) for r in got] == [
        (10.0, 5, 0), (10.0, 3, 0), (10.5, 4, 0), (10.5, 3, 0), (10.5, 3, 1), (10.5, 3, 1)]


def test_a_symbol_on_two_channels_is_an_error(spark):
    events = [event(1, "add", 10.0, 5, "buy", key=7), event(1, "add", 10.2, 70, "buy", key=8, channel=2)]
    with pytest.raises(Exception, match="two channels"):
        book(spark, events)
