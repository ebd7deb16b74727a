"""Problem 4: cutoffs are chosen from the counts of all pairs."""

from procmill.llm import defects as D


def test_cutoffs_weigh_the_counts_of_all_pairs():
    tables = {d: {"1111": 1.0, "1100": 0.4, "0000": 0.0} for d in D.DEFECTS}
    at = lambda hit, odd: D.expected_cutoffs(tables, {d: {"1111": hit, "1100": odd, "0000": 10_000} for d in D.DEFECTS})["refusal"]
    assert at(1000, 10) > 0.4  # ten doubtful pairs would cost more than they bring
    assert at(1, 1000) < 0.4  # here nearly all defects are among the doubtful ones
    assert D.expected_cutoffs(tables, {d: {} for d in D.DEFECTS}) == {d: 0.5 for d in D.DEFECTS}


def test_no_pair_is_read_again_to_choose_cutoffs(spark, monkeypatch):
    monkeypatch.setattr(D, "cutoffs", None)
    monkeypatch.setattr(D, "plant", None)
    good = "---PROCESS---\nPROCESS: Order check\n\nACTORS:\n- Clerk\n\nMAIN FLOW:\n1. Clerk check the order\n\nNOTES:\n- None.\n---END_PROCESS---"
    df = spark.createDataFrame([(i, "succeeded", "The clerk checks the order and sends it.", "" if i < 3 else good) for i in range(60)], "id long, status string, i string, o string")
    words = spark.createDataFrame([("en", w) for w in ("the", "and", "it", "to")], "lang string, word string")
    got = {tuple(r) for r in D.found(D.pair_rows([(df, "t", "i", "o")]), words).collect()}
    assert got == {("t", i, "empty") for i in range(3)}
