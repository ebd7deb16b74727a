"""Problem 4: votes, the label model, planted defects on clean pairs, odd cases."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from procmill.llm import defects as D
from procmill.session import table

LISTS = {"en": frozenset("the of and to in a is for with be this not".split()), "pt": frozenset("de a o que e do da em um para com não uma os se na".split()), "de": frozenset("der die das und in den von zu mit ein".split())}
GOOD = "---PROCESS---\nPROCESS: Order check\n\nACTORS:\n- Clerk\n\nMAIN FLOW:\n1. Clerk check the order\n2. Clerk send it to the office\n\nNOTES:\n- We are sorry, we are unable to accept the card.\n---END_PROCESS---"
MODEL = json.dumps({"pool": "Order check", "lanes": [], "nodes": [{"id": "a", "type": "task", "name": "Check the order"}, {"id": "b", "type": "task", "name": "Send it to the office"}], "flows": [{"id": "f", "from": "a", "to": "b"}]})
INPUT = "When the order arrives at the office, the clerk checks it against the list and then sends it to the next desk for approval by the end of the day."
CASES = [
    (GOOD, None), (MODEL, None), ("```json\n" + MODEL + "\n```", None), (json.dumps(MODEL), None), ("Here is the model:\n" + MODEL, None), (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("N/A", "empty"), ("```\n```", "empty"), ("{}", "empty"), ('{"pool":"","lanes":[],"nodes":[],"flows":[]}', "empty"),
    ("---PROCESS---\n---END_PROCESS---", "empty"), ("I'm sorry, but I can't help with this transcript.", "refusal"), (json.dumps({"error": "Unfortunately, I cannot complete this request."}), "refusal"), (INPUT, "copy"), (INPUT.upper(), "copy"), ("Here is the text:\n\n" + INPUT, "copy"), ("---PROCESS---\n" + INPUT + "\n---END_PROCESS---", "copy"),
    (GOOD[:120], "truncated"), (MODEL[:90], "truncated"), (MODEL[:-20], "truncated"), ("```json\n" + MODEL[:120], "truncated"), (json.dumps(MODEL)[:100], "truncated"),
    ("PROCESSO: Conferir o pedido\n\nATORES:\n- O caixa da loja\n\nFLUXO PRINCIPAL:\n1. O caixa da loja: conferir o pedido\n\nNOTAS:\n- Não se envia para o setor.", "other_language"), (MODEL.replace("Check the order", "Prüfen das Formular").replace("Send it to the office", "Senden den Bericht mit der Anlage").replace("Order check", "Melden die Rechnung"), "other_language"),
]


@pytest.mark.parametrize("answer,want", CASES)
def test_votes(answer, want):
    got = dict(zip(D.DEFECTS, D.Voter(LISTS).votes(INPUT, answer)))
    strong = {d for d, p in got.items() if 2 * p.count("1") > len(p) - p.count("-")}
    assert strong == ({want} if want else set()), got


def test_label_model_learns_what_to_trust():
    q = D.posteriors({"000": 9000, "111": 100, "110": 20, "100": 200, "-00": 500, "-11": 5})
    assert q["111"] > 0.99 and q["110"] > 0.9 and q["-11"] > 0.9 and q["000"] < 0.001 and q["100"] < 0.5 and D.posteriors({}) == {}
    alone = D.posteriors({"111": 3})
    assert alone["111"] > 0.9


def lists(spark):
    return spark.createDataFrame([(k, w) for k, v in LISTS.items() for w in v], "lang string, word string")


def frame(spark, cases):
    return spark.createDataFrame([(i, "succeeded", INPUT, a, "x", 1) for i, (a, _) in enumerate(cases)] + [(99, "failed", INPUT, "", "x", 1), (None, "succeeded", INPUT, "", "x", 1)], "id long, status string, input_text string, output_text string, defect string, row_id int")


def test_found(spark):
    cases = CASES + [(GOOD, None)] * 60
    pairs = D.pair_rows([(frame(spark, cases), "t", "input_text", "output_text")])
    got = {r.row_id: r.defect for r in D.found(pairs.union(pairs), lists(spark)).collect()}
    assert got == {i: d for i, (_, d) in enumerate(cases) if d}
    assert D.labels(pairs, lists(spark)).where(F.col("posterior") < 0.5).isEmpty()


def test_several_defects_are_kept(spark):
    odd = "PROCESSO: Conferir o pedido\n\nATORES:\n- O caixa da loja\n\nFLUXO PRINCIPAL:\n1. O caixa da loja: conferir o pedido com a"
    pairs = D.pair_rows([(frame(spark, [(odd, None)] + [(GOOD, None)] * 50), "t", "input_text", "output_text")])
    assert {r.defect for r in D.labels(pairs, lists(spark)).where("row_id = 0").collect()} == {"truncated", "other_language"}


def test_empty_and_null(spark):
    pairs = D.pair_rows([(frame(spark, CASES).limit(0), "t", "input_text", "output_text")])
    assert D.found(pairs, lists(spark)).count() == 0
    none = spark.createDataFrame([(1, "succeeded", None, None), (2, "succeeded", None, GOOD), (3, "succeeded", None, "x " * 100_000 + ".")], "id long, status string, input_text string, output_text string")
    assert {r.row_id: r.defect for r in D.found(D.pair_rows([(none, "t", "input_text", "output_text")]), lists(spark).limit(0)).collect()} == {1: "empty"}


def sample(spark):
    """Votes of all pairs of sf0.01, what the label model makes of them, and pairs without a likely defect."""
    d = "/root/testdata/sf0.01"
    rows = D.pair_rows([(table(spark, d, "preprocessing_generations"), "p", "input_text", "output_text"), (table(spark, d, "json_bpmn_generations"), "j", "input_preprocess", "output_json")]).collect()
    lists_of: dict = {}
    for r in table(spark, d, "common_words").collect():
        lists_of.setdefault(r.lang, set()).add(r.word)
    v = D.Voter({k: frozenset(x) for k, x in lists_of.items()})
    votes = [v.votes(r.given, r.answer) for r in rows]
    counts = {k: dict(Counter(x[i] for x in votes)) for i, k in enumerate(D.DEFECTS)}
    tables = {k: D.posteriors(c) for k, c in counts.items()}
    clean = [(r.given, r.answer) for r, x in zip(rows, votes) if r.given and r.answer and all(tables[k][p] < 0.5 for k, p in zip(D.DEFECTS, x))]
    return v, counts, tables, clean[:300]


def test_planted_defects_are_found_and_the_model_beats_the_majority(spark):
    """Cutoffs from one half of the planted pairs, found in the other half; excuses and stand-ins that no function lists."""
    v, counts, tables, clean = sample(spark)
    cut = D.cutoffs(v, clean, tables, counts)
    model, majority = Counter(), Counter()
    for no, (g, a) in enumerate(clean):
        assert all(tables[k][p] <= cut[k] for k, p in zip(D.DEFECTS, v.votes(g, a)))
        if no % 2:
            for i, (k, pair) in enumerate(D.plant(g, a, no).items()):
                p = v.votes(*pair)[i]
                model[k] += tables[k][p] > cut[k]
                majority[k] += 2 * p.count("1") > len(p) - p.count("-")
    assert all(model[k] >= 0.97 * (len(clean) // 2) for k in D.DEFECTS), model
    assert model.total() > majority.total() and all(model[k] >= majority[k] for k in D.DEFECTS), (model, majority)


@pytest.mark.parametrize("text", ["I'd rather not write this process description.", "Please provide the transcript first so that I can begin.", "I will not do that.", "Could you tell me more before I start on your text?", "We have to stop here; your document needs somebody else."])
def test_refusals_in_words_that_no_list_has(spark, text):
    v, counts, tables, clean = sample(spark)
    for given, _ in clean[:20]:
        got = {k: tables[k][p] for k, p in zip(D.DEFECTS, v.votes(given, text))}
        assert max(got, key=got.get) == "refusal" and got["refusal"] > 0.9, got
