"""The trie against brute force: odd turns, shared heads, hot conversations, shards and tops of every size."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from longpanel.llm import conversation_trie as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONV = "conv_id long, turn long, role string, text string"


def brute_rebuilt(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in by.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def brute(convs):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        own = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        saved[p] = own + sum(saved[k] for k in kids[p])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def made(seed, n=150, vocabulary=3):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.1:
            continue
        for k in range(r.choice([1, 2, 3, 5, 9])):
            rows.append((c - 30, k if r.random() < 0.95 or k else None, r.choice(["user", "assistant", None, ""]) if r.random() < 0.3 else "user",
                         r.choice([None, "", " a  b\n"]) if r.random() < 0.1 else f"t{r.randrange(vocabulary)} said again"))
    # ties of turn in one conversation are avoided: their order is by hash
    seen, out = set(), []
    for row in rows:
        if row[:2] not in seen:
            seen.add(row[:2])
            out.append(row)
    return out


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("seed,tops,in_memory", [(1, None, None), (2, 1, None), (3, 7, 2), (4, 100_000, 3), (5, 30, 1)])
def test_against_brute_force(spark, seed, tops, in_memory):
    rows = made(seed)
    d = spark.createDataFrame(rows, CONV).repartition(5)
    for c in ("conv", "k", "a", "b", "d", "n", "p", "px", "block", "shard"):
        d = d.withColumn(c, F.lit("clash"))
    assert result(T.rebuilt_trie(d, tops, in_memory)) == brute(brute_rebuilt(rows))


def test_long_conversations_and_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 4)
    monkeypatch.setattr(T, "IDS", 10)
    r = random.Random(7)
    long = [("user", f"w {r.randrange(5)}") for _ in range(300)]
    rows = [(c, k, *x) for c in (40, 41, 42) for k, x in enumerate(long[:300 - c % 3])]
    rows += [(c, k, "user", f"hello {k}") for c in range(100, 340) for k in range(5)]
    rows += [(c, k, "user", "hello 0" if k == 0 else f"own {c}") for c in range(400, 480) for k in range(5)]
    d = spark.createDataFrame(rows, CONV).repartition(7)
    assert result(T.rebuilt_trie(d)) == brute(brute_rebuilt(rows))


def test_turnless_conversations_nulls_ties_and_empty_tables(spark):
    rows = [(c, 0, None, None) for c in range(1, 60) if c % 20] + [(None, 1, "user", "x")]
    d = spark.createDataFrame(rows, CONV)
    want = brute(brute_rebuilt(rows))
    assert result(T.rebuilt_trie(d)) == want and want[0][1] == 0 and want[0][7] != hashlib.sha256().hexdigest()
    assert T.rebuilt_trie(spark.createDataFrame([], CONV)).collect() == []
    assert T.rebuilt_trie(spark.createDataFrame([(None, 1, "user", "x")], CONV)).collect() == []
    twice = [(5, 0, "user", "same"), (5, 0, "user", "same"), (6, None, "user", "long " * 200_000), (6, 0, "user", "x")]
    got = T.trie(*(lambda t: (t, t.select("conv").distinct()))(T.turns(spark.createDataFrame(twice, CONV)))).collect()
    assert sorted((r.depth, r.n_convs, r.n_leaves) for r in got) == [(0, 2, 2), (1, 1, 1), (1, 1, 1), (2, 1, 1), (2, 1, 1)]


def test_queue_spills_and_merges():
    r = random.Random(3)
    places = sorted({(-r.randrange(50), r.randrange(40), 1) for _ in range(900)})
    sent = [(r.choice(places), r.randrange(9), r.randrange(9)) for _ in range(5000)]
    for limit in (1, 50, 10_000):
        q = T.SpillingQueue(limit)
        for m in sent:
            q.push(*m)
        for p in places:
            mine = [m for m in sent if m[0] == p]
            assert q.take(p) == (len(mine), sum(m[1] for m in mine), sum(m[2] for m in mine))
        assert not q.heap and not q.heads
    q.push(places[0], 1, 1)
    with pytest.raises(ValueError):
        q.take(places[1])
