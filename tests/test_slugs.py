"""Slugs of all documents by the reference's rule, in Python's regular expressions."""

import re

from procmill.plans import text as P


def rule(t):
    return t if t is None else re.sub(r"[\s-]+", "_", re.sub(r"[^\w\s-]", "", t.lower()).strip())[:60]


def test_slugs_of_every_language(spark, tmp_path):
    titles = [("en", "Check the  form - now!"), ("pt", " Revisão nº 2: Aprovação"), (None, "Größe prüfen"), ("EN", "Naïve café"), ("es", "Año—niño"), ("de", None), ("x", "処理 手順 (1)"), ("en", "é" * 70)]
    rows = [(i, lang, t) for i, (lang, t) in enumerate(titles)]
    spark.createDataFrame(rows, "doc_id long, lang string, title string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.slug for r in P.slugs(spark, str(tmp_path)).collect()} == {i: rule(t) for i, _, t in rows}


def test_sample_data(spark):
    d = "/root/testdata/sf0.01"
    want = {r.doc_id: rule(r.title) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id: r.slug for r in P.slugs(spark, d).collect()} == want
