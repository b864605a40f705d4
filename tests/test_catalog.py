"""Every catalogue query against its SQL on the smallest tables, and the driver contract."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_module  # noqa: E402
from tools.check_oracle import TABLES, compare, key, norm  # noqa: E402

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


# every query when asked for, else a few of each family (the whole run takes some minutes)
FULL = os.environ.get("FULL_CATALOG") == "1"
# on the smallest tables these have no cross-section of the default size
NEED_MORE_NAMES = {"eval_decay", "eval_factor_ranking", "eval_half_life",
                   "eval_ic_summary_newey_west", "eval_quantile_summary", "screen_verdicts"}


def chosen(names):
    if FULL:
        return sorted(names)
    seen, out = {}, []
    for n in sorted(names):
        family = n.split("_")[0]
        seen[family] = seen.get(family, 0) + 1
        if seen[family] <= 3 and n not in NEED_MORE_NAMES:
            out.append(n)
    return out


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def test_contract(spark):
    assert set(SQL) <= set(QUERIES) and len(SQL) > 100
    df = entry_module.entry(spark)
    assert df.columns == ["factor", "ts", "ic", "n"] and df.count() > 0


@pytest.mark.parametrize("name", chosen(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    folder = sf_dir.replace("0.001", "0.01") if name in NEED_MORE_NAMES else sf_dir
    duck = connect(folder)
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = [[norm(v) for v in r] for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    rel = duck.execute(SQL[name])
    names = [c[0] for c in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = [[norm(r[i]) for i in order] for r in rel.fetchall()]
    assert sorted(names) == cols and len(got) == len(want)
    got.sort(key=key)
    want.sort(key=key)
    assert not [b for b in compare(got, want) if not b[4]][:5]


@pytest.mark.parametrize("name", chosen(set(QUERIES) - set(SQL) - {
    "model_walk_forward_linear", "model_walk_forward_boosted"}))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0
