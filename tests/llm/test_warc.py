"""Archives: exact round trips, and what the reader salvages from damaged ones."""

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from longpanel.llm import warc

PAGE = "page_id long, url string, html string"


def expected(rows, least=100):
    """(page_id, bytes, digest, type, refers_to) by the definitions."""
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = b in first and first[b] != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out)


def pages(seed=1, n=60):
    r = random.Random(seed)
    htmls = ["".join(r.choice("abc <>é\r\nWARC/1.1 ") for _ in range(r.randint(0, 400))) for _ in range(n)]
    copies = ["x" * 99, "x" * 100, "é" * 50, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9]
    rows = [(i, f"https://h/{i}?a b\r\nX: é", h) for i, h in enumerate(htmls)]
    rows += [(n + i, None if i % 2 else "u", copies[i % 4]) for i in range(20)] + [(n + 20, "u", None), (n + 21, "", ""), (n + 22, "u", "y" * 3_000_000)]
    return rows


def test_round_trip(spark):
    rows = pages()
    d = spark.createDataFrame(rows, PAGE).repartition(5).withColumn("row", F.lit("clash")).withColumn("payload", F.lit(1))
    got = warc.round_trip(d, roll_bytes=3_000).collect()
    assert sorted(map(tuple, (r[:5] for r in got))) == expected(rows)
    assert len({r.file for r in got}) > 5


def test_nulls_ties_and_empty_tables(spark):
    h = "z" * 200
    d = spark.createDataFrame([(None, "u", h), (None, "u", h), (7, "u", h), (7, "u", h), (9, None, None)], PAGE)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(d).collect()), key=str)
    assert got.count((7, "response", None)) == 1 and got.count((7, "revisit", 7)) == 1
    assert got.count((None, "revisit", 7)) == 2 and got.count((9, "response", None)) == 1
    only = warc.round_trip(spark.createDataFrame([(None, "u", h)] * 3, PAGE)).collect()
    assert sorted(r.record_type for r in only) == ["response", "revisit", "revisit"] and {r.refers_to for r in only} == {None}
    assert warc.round_trip(spark.createDataFrame([], PAGE)).collect() == []


def made(n=40, seed=5, digests=True):
    """Records, and the id and payload of each."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        body = bytes(r.choice(b"abcdefgh \n") for _ in range(r.randint(1, 3000)))
        rec = warc.record("response", f"urn:page:{i}:{i}", b"HTTP/1.1 200 OK\r\n\r\n" + body, [("Content-Type", "application/http")], "d")
        if not digests:
            rec = b"".join(x for x in rec.splitlines(True) if not x.startswith(b"WARC-Block-Digest"))
        out.append((f"urn:page:{i}:{i}", body, rec))
    return out


def read(data, members):
    rows = list(warc.records(io.BytesIO(data), len(data), members))
    return {r["record_id"]: r["payload"] for r in rows if "failed" not in r}, [
        (r["offset"], r["gap_end"], r["failed"]) for r in rows if "failed" in r], rows


@pytest.mark.parametrize("members", [True, False])
@pytest.mark.parametrize("digests", [True, False])
def test_damage_costs_only_the_records_it_touches(members, digests):
    recs = made(digests=digests)
    parts = [warc.member(x[2]) if members else x[2] for x in recs]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    data = b"".join(parts)
    assert read(data, members)[:2] == ({i: b for i, b, _ in recs}, [])
    r = random.Random(9)
    for case in range(60):
        kind = case % 4
        at = r.randrange(len(data))
        size = r.choice([1, 5, 700, 5000])
        if kind == 0:  # bytes overwritten
            bad = data[:at] + bytes(r.randrange(256) for _ in range(len(data[at:at + size]))) + data[at + size:]
            shift, touched = 0, (at, min(len(data), at + size))
        elif kind == 1:  # bytes lost
            bad = data[:at] + data[at + size:]
            shift, touched = -len(data[at:at + size]), (at, min(len(data), at + size))
        elif kind == 2:  # bytes put in
            bad = data[:at] + bytes(r.randrange(256) for _ in range(size)) + data[at:]
            shift, touched = size, (at, at + 1)
        else:  # cut off
            bad, shift, touched = data[:at], 0, (at, len(data))
        got, gaps, rows = read(bad, members)
        whole = {i for k, (i, _, _) in enumerate(recs) if starts[k + 1] <= touched[0] or starts[k] >= touched[1]}
        if kind == 2:  # put in between two records, both stay
            whole = {i for k, (i, _, _) in enumerate(recs) if starts[k + 1] <= at or starts[k] >= at}
        assert whole <= set(got), (case, whole - set(got))
        if digests or members:  # what no digest and no checksum guards may come back changed
            assert all(got[i] == b for i, b, _ in recs if i in got)
        # without a check on the text, changed text is no failure
        if len(bad) and set(got) != {x[0] for x in recs} and bad != data[:starts[-1]][:len(bad)]:
            assert gaps or not (digests or members)
        for (a, b, why), (c, _, _) in zip(gaps, [*gaps[1:], (len(bad), 0, 0)]):
            assert 0 <= a < b <= c and why
        # nothing at the start goes unreported
        if bad:
            assert rows[0]["offset"] == 0


def test_many_records_in_one_member():
    recs = made(30)
    data = gzip.compress(b"".join(x[2] for x in recs))
    assert read(data, True)[:2] == ({i: b for i, b, _ in recs}, [])
    got, gaps, _ = read(data[:len(data) // 2], True)
    assert 5 < len(got) < 30 and all(got[i] == b for i, b, _ in recs if i in got)
    assert gaps == [(0, len(data) // 2, "member is cut off")]


def test_large_members_are_inflated_twice(monkeypatch):
    monkeypatch.setattr(warc, "KEPT", 1000)
    monkeypatch.setattr(warc, "PIECE", 512)
    recs = made(12)
    parts = [warc.member(x[2]) for x in recs]
    assert read(b"".join(parts), True)[:2] == ({i: b for i, b, _ in recs}, [])
    bad = b"".join(parts[:3]) + parts[3][:50] + b"".join(parts[4:])
    got, gaps, _ = read(bad, True)
    assert set(got) == {x[0] for x in recs} - {recs[3][0]} and len(gaps) == 1
    plain = b"".join(x[2] for x in recs)
    assert read(plain[7:], False)[0].keys() == {x[0] for x in recs[1:]}


def test_lengths_that_lie_are_not_read():
    recs = made(6)
    lie = recs[2][2].replace(b"Content-Length: ", b"Content-Length: 99999")
    got, gaps, _ = read(b"".join([recs[0][2], recs[1][2], lie, *(x[2] for x in recs[3:])]), False)
    assert set(got) == {x[0] for x in recs} - {recs[2][0]} and gaps[0][2] == "end of record"


def test_foreign_digests_and_tolerated_ends():
    import base64

    body = b"HTTP/1.0 200 OK\n\nhello"
    sha1 = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    head = f"WARC/1.0\nWARC-Type: response\nContent-Type: application/http\nWARC-Payload-Digest: sha1:{{}}\nContent-Length: {len(body)}\n\n"
    good = head.format(sha1).encode() + body + b"\n\n"
    wrong = head.format("A" * 32).encode() + body + b"\n\n"
    _, gaps, rows = read(good + wrong + good, False)
    assert [r.get("payload") for r in rows] == [b"hello", None, b"hello"] and gaps[0][2] == "payload digest"


def test_read_of_a_damaged_folder(spark, tmp_path):
    recs = made(50)
    parts = [warc.member(x[2]) for x in recs]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts[:20]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(parts[20:25]) + parts[25][:-1] + b"junk" + b"".join(parts[26:]))
    (tmp_path / "c.warc").write_bytes(b"".join(x[2] for x in recs[:3]))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    got = warc.read(spark, str(tmp_path))
    assert got.where("failed IS NULL").count() == 20 + 29 + 3
    gap = got.where("failed IS NOT NULL").collect()
    begin = sum(map(len, parts[20:25]))
    assert [(g.file, g.offset, g.gap_end) for g in gap] == [("b.warc.gz", begin, begin + len(parts[25]) + 3)]
