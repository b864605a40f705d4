"""Every context of a URL keeps its own counts, however many there are."""

import collections
import math
import random
import re
import zlib

import pytest

from longpanel.llm import joins, url_filter as U


def fold(u):
    return U.PAD + re.sub(r"[^\x21-\x7E]", "~", re.sub(r"[1-9]", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in u)))


def brute(urls, seen):
    """Scores from counts of whole contexts."""
    n = collections.Counter()
    for u, fine in seen:
        f = fold(u)
        for i in range(U.ORDER, len(f)):
            for k in range(U.ORDER + 1):
                n[fine, f[i - k:i + 1]] += 1
                n[fine, f[i - k:i], "context"] += 1
    out = []
    for u in urls:
        f, total = fold(u), 0.0
        for i in range(U.ORDER, len(f)):
            for fine in (True, False):
                p = 1 / U.SYMBOLS
                for k in range(U.ORDER + 1):
                    p = (n[fine, f[i - k:i + 1]] + U.LEAN * p) / (n[fine, f[i - k:i], "context"] + U.LEAN)
                total += math.log(p) * (1 if fine else -1)
        out.append(total / (len(f) - U.ORDER) if u else 0.0)
    return out


def test_scores_of_more_contexts_than_slots(spark, monkeypatch):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz-_.~") for _ in range(n))
    urls = [f"http://h{i}.{'example.net/de/' if i % 2 else 'example.org/es/'}{text(90)}" for i in range(1500)]
    urls += [f"http://h.com/{text(40)}" for _ in range(60)] + ["", "é", "x"]
    given = [(u, "net/de/" in u) for u in urls if "net/de/" in u or "org/es/" in u]
    # digits that matter to a rule lie in paths that begin with /de/8
    given = [(u, fine) for u, fine in given if zlib.crc32(u.encode()) % 5]
    assert len({fold(u)[i:i + 5] for u, _ in given for i in range(len(fold(u)) - 4)}) > 1 << 16
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    got = {x.page_id: x for x in U.judge(d).collect()}
    for i, want in enumerate(brute(urls, given)):
        assert got[i].score == pytest.approx(want, abs=1e-9), urls[i]
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    again = {x.page_id: x for x in U.judge(d).collect()}
    assert again == got and len(got) == len(urls)
