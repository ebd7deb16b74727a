"""Names of splits count whatever their case and the blanks around them."""

from procmill.plans import text as P

RUN = " ".join(f"w{i}" for i in range(10))


def folder(spark, tmp_path):
    rows = [("a", " Holdout", "s", "Check the form", RUN), ("b", "SFT ", "s", "Other", RUN), ("c", "VALIDATION ", "s", "Check a form", "x"), ("d", None, "s", "Check the form", RUN)]
    spark.createDataFrame(rows, "id string, split string, source string, title string, raw_text string").write.parquet(str(tmp_path / "samples.parquet"))
    return str(tmp_path)


def test_contamination(spark, tmp_path):
    assert [tuple(r) for r in P.ngram_contamination(spark, folder(spark, tmp_path)).select("id", "n_grams", "n_shared").collect()] == [("a", 3, 3)]


def test_alignment(spark, tmp_path):
    assert [tuple(r) for r in P.label_jaccard_align(spark, folder(spark, tmp_path)).collect()] == [("a", "c", 0.5)]
