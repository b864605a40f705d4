"""Wrappers take part of every page of a host, however many shapes these have."""

import pytest

from longpanel.llm import html_wrappers


@pytest.mark.parametrize("fan", [2, 32])
def test_every_page_widens_the_wrapper(spark, monkeypatch, fan):
    rows = [(i, f"http://h/{i}", "<body>" + (f"<section id='s{i}'>x</section>" if i % 10 == 0 else "")
             + f"<div class=post>{'many words here ' * 9}{i}</div><div class=comments>c</div></body>") for i in range(200)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    w = html_wrappers.wrappers(d, fan=fan).collect()
    assert len(w) == 1 and w[0]["main"] == "div.post"
    assert all(f"section.s{i} " in w[0]["pattern"] for i in range(0, 200, 10))


def test_main_element_by_the_text_of_all_pages(spark):
    # the pages with much text are few; most have a short teaser in another element
    rows = [(i, f"http://h/{i}", f"<body><div class=story>teaser {i}</div></body>") for i in range(300)]
    rows += [(1000 + i, f"http://h/long{i}", f"<body><div class=content>{'long text of the page ' * 200}{i}</div></body>") for i in range(4)]
    w = html_wrappers.wrappers(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert w[0]["main"] == "div.content"
