"""Shared session and helpers."""

import math
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def hot(spark):
    """Force the plans for oversized groups: no group above 7 rows may reach one task."""
    from longpanel.functions.ordered import LIMIT_CONF

    class Switch:
        def __enter__(self):
            spark.conf.set(LIMIT_CONF, "7")

        def __exit__(self, *exc):
            spark.conf.unset(LIMIT_CONF)

    yield Switch()
    spark.conf.unset(LIMIT_CONF)


def rows(df, *keys):
    """Collected rows as dicts, ordered by keys."""
    out = [r.asDict() for r in df.collect()]
    names = list(keys) or df.columns
    return sorted(out, key=lambda r: tuple((r[k] is None, r[k]) for k in names))


def same(a, b, keys, tol=1e-9):
    """Both frames hold the same rows, up to rounding."""
    x, y = rows(a.select(*sorted(a.columns)), *keys), rows(b.select(*sorted(b.columns)), *keys)
    assert a.columns and sorted(a.columns) == sorted(b.columns)
    assert len(x) == len(y) > 0
    for r, s in zip(x, y):
        for k in r:
            u, v = r[k], s[k]
            if isinstance(u, float) and isinstance(v, float):
                assert math.isclose(u, v, rel_tol=tol, abs_tol=tol), (k, r, s)
            else:
                assert u == v, (k, r, s)
