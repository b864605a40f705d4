"""Columns named like what the operators add, very long texts, and samples that one text may not end."""

import random

from pyspark.sql import functions as F

from longpanel.llm import language_id, rows, signature_trees

CLASH = ("cut", "h", "n", "k", "sum", "least", "calibrates", "_row", "_n", "_path", "_file", "_place", "_copy", "row", "file", "path", "node", "size", "key")


def texts(n=120, seed=2):
    r = random.Random(seed)
    a, b = ["the", "and", "house", "river", "over", "stone"], ["der", "und", "haus", "fluss", "stein", "gegen"]
    return [(i, " ".join(r.choice(a if i % 2 else b) for _ in range(60)), "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(n)]


def table(spark, data, tmp_path, clash=True):
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for c in CLASH if clash else ():
        d = d.withColumn(c, F.lit("clash"))
    d.write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def test_stages_with_clashing_columns(spark, sf_dir, tmp_path):
    import corpus_pipeline

    data = texts()
    docs = table(spark, [*data, (500, data[3][1], "en", "s1", 1), (501, data[3][1], "en", "s1", 1)], tmp_path)
    for k, (name, step) in enumerate(corpus_pipeline.STAGES[:4]):
        out = step(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        ids = [r.doc_id for r in docs.collect()]
        if k == 1:
            assert 3 in ids and 500 not in ids and 501 not in ids
    assert ids and docs.where("cut <> 'clash'").count() == 0


def test_operators_with_clashing_columns(spark, tmp_path):
    docs = table(spark, texts(), tmp_path)
    found = language_id.identify(docs, *language_id.fit(docs)).collect()
    lang = {d[0]: d[2] for d in texts()}
    assert sum(r.lang_pred == lang[r.doc_id] for r in found) == len(lang)
    assert rows.with_row(docs, "row_number").select("row_number").distinct().count() == len(lang)
    assert signature_trees.linked(docs).count() == len(lang)


def test_one_long_text_does_not_end_a_sample(spark, tmp_path):
    long = [(1000 + i, "the river and the stone over " * 20_000, "en", "s", 1) for i in range(6)]
    docs = table(spark, [*texts(), *long], tmp_path, clash=False)
    s = language_id.sample(docs, max_chars=40_000).groupBy("lang", "calibrates").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("m")).collect()
    assert {r.lang for r in s if not r.calibrates} == {"en", "de"} and max(r.m for r in s) <= 2_000
    assert sum(r.n for r in s if r.lang == "en") > 20
    one = language_id.sample(docs.where("lang = 'en'").orderBy("doc_id").limit(3)).collect()
    assert not one or any(not r.calibrates for r in one)
