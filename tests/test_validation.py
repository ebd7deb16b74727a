"""Names, schemas, matching, and trust in measures, on small tables worked out by hand."""

import pytest

from procmill.functions import codecs as C
from procmill.functions import graphs as G
from procmill.functions import text as X
from procmill.operators import pipeline as P
from procmill.operators import relational as O
from procmill.operators import validation as V
from procmill.sources import files, schemas as S


def test_numbers_that_are_taken_are_passed_over(spark):
    df = spark.createDataFrame([(i, "k", n) for i, n in enumerate(["a", "a", "a_2", "a", "b", "a_4", "b", "x_1"])], "i int, k string, n string")
    got = {r.i: r.m for r in O.first_wins(df, "n", ["k"], ["i"], "m").collect()}
    assert got == {0: "a", 1: "a_3", 2: "a_2", 3: "a_5", 4: "b", 5: "a_4", 6: "b_2", 7: "x_1"} and len(set(got.values())) == 8


def test_bijections(spark):
    s = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.2), ("b", "y", 0.5), ("b", "x", 0.4)], "a string, b string, s double")
    assert {(r.a, r.b) for r in O.matched_one_to_one(s, "a", "b", "s", 2, 2).collect()} == {("a", "x"), ("b", "y")}
    with pytest.raises(ValueError, match="no bijection"):
        O.matched_one_to_one(s.where("b = 'x'"), "a", "b", "s", 2, 2)
    with pytest.raises(ValueError, match="1 of 2"):
        O.matched_one_to_one(s.where("a = 'a'"), "a", "b", "s", 2, 2)
    assert X.matching_ratio("abcd", "bcde") == 0.75 and X.matching_ratio("", "") == 1.0 and X.matching_ratio(None, "a") is None


def test_schemas(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, None)], "id int, name string")
    more = S.add_column(df, "score", "double", 0.5)
    assert S.add_column(more, "score", "double").columns == ["id", "name", "score"] and {r.score for r in more.collect()} == {0.5}
    with pytest.raises(ValueError, match="score is double"):
        S.add_column(more, "score", "string")
    assert S.conform(df, "name string, id bigint, extra date").dtypes == [("name", "string"), ("id", "bigint"), ("extra", "date")]
    other = spark.createDataFrame([(1,)], "key int")
    assert S.check(df, ["name"], ["id"], [("id", other, "key")]) == {"null name": 1, "repeated id": 1, "id without key": 2}
    with pytest.raises(ValueError, match="break rules"):
        S.rebuild(df, str(tmp_path / "t"), "id bigint", unique=["id"])
    assert not (tmp_path / "t").exists()
    assert S.rebuild(df, str(tmp_path / "t"), "id bigint, name string").count() == 3
    with pytest.raises(ValueError, match="not empty"):
        S.rebuild(df, str(tmp_path / "t"), "id bigint")
    with pytest.raises(ValueError, match="3 rows instead of 5"):
        S.rebuild(df, str(tmp_path / "u"), "id bigint", rows=5)
    assert not (tmp_path / "u").exists()


def test_manifest_says_how_long_texts_are(spark):
    df = spark.createDataFrame([(str(i), "x" * i) for i in range(1, 11)], "id string, text string")
    assert '"n_chars":{"q25":3,"q50":6,"q75":8,"max":10}' in files.manifest(df, "e", df.limit(0), "id", "text").first()[0]


def test_reliability(spark):
    rows = [("p", "a", 1, 1.0, 2.0), ("p", "a", 2, 3.0, 2.0), ("p", "b", 1, 4.0, 5.0), ("q", "c", 1, 0.0, 1.0), ("q", "c", 2, 0.4, 1.0), ("q", "d", 1, 5.0, 0.0), ("q", "e", 1, None, 3.0)]
    r = V.reliability(spark.createDataFrame(rows, "c string, t string, r int, s double, e double"), "c", "t", "r", "s", "e", (1, 2)).first()
    assert (r.n_targets, r.n_clusters, r.spread_share, r.n_within) == (4, 2, 0.5, 2) and r.mae == pytest.approx((0 + 1 + 0.8 + 5) / 4) and r.within_rho == 0.0 and r.rho == pytest.approx(-0.2) and r.rho_1_2 == pytest.approx(1.0)


def test_acceptance(spark):
    good = [(i, k, n, v) for i in "abc" for k, n, v in (("intact", 0, 1.0), ("drop", 1, 0.8), ("swap", 1, 0.7), ("triple", 3, 0.4), ("paraphrase", 0, 0.95))] + [("z", "drop", 1, 0.1), ("a", "add", 1, None)]
    make = lambda rows: spark.createDataFrame(rows, "item string, kind string, n int, v double")
    r = V.acceptance(make(good), "item", "kind", "n", "v").first()
    assert (r.n_items, r.n_cases, r.c1, r.c3, r.passes) == (3, 15, 1.0, 1.0, 1) and r.c2 < -0.9 and r.mean_loss_3 == pytest.approx(-0.6)
    flat = V.acceptance(make([(i, k, n, 1.0) for i, k, n, _ in good]), "item", "kind", "n", "v").first()
    assert flat.passes == 0 and flat.c1 == 0.5 and (flat.c2 is None or flat.c2 != flat.c2) and V.acceptance(make([]), "item", "kind", "n", "v").first().passes == 0


def test_contrast_of_too_few_pairs(spark):
    r = V.contrast(spark.createDataFrame([(1, 0.5)], "item long, d double"), "item", 0.1, 100, 1).first()
    assert (r.n, r.diff, r.low, r.p, r.verdict) == (1, None, None, None, None)
    same = V.contrast(spark.createDataFrame([(i, 0.0) for i in range(5)], "item long, d double"), "item", 0.1, 100, 1).first()
    assert (same.n, same.diff, same.p, same.verdict) == (5, 0.0, 1.0, "equivalent")


def test_cases_of_several_defects(spark):
    nodes = {"s": "startEvent", "p": "parallelGateway", "a": "task", "b": "task", "q": "parallelGateway", "c": "task", "e": "endEvent"}
    g = G.Graph("P", {i: G.Node(i, k, "" if i in "spqe" else f"Do {i} well") for i, k in nodes.items()}, [G.Edge(f"f{k}", x, y) for k, (x, y) in enumerate(["sp", "pa", "pb", "aq", "bq", "qc", "ce"])])
    many, n = C.perturb_many([g], list(C.OPERATORS), 1)
    assert n >= 3 and C.render(many) != C.render([g]) and C.perturb_many([G.Graph("P")], ["drop"], 1) is None
    df = spark.createDataFrame([("m", C.to_xml([g])), ("bad", "<x"), ("none", None)], "id string, xml string")
    got = {r.kind: r for r in P.cases(df, ["id"], "xml", "xml").collect()}
    assert {k: r.n_defects for k, r in got.items()} == {"intact": 0, "drop": 1, "add": 1, "swap": 1, "exclusive": 1, "triple": 3, "paraphrase": 0}
    assert "WELL" in got["paraphrase"].xml and len({r.xml for r in got.values()}) == 7


def test_thresholds_from_one_reading():
    names = lambda *ns: C.to_xml([G.Graph("P", {n: G.Node(str(k), "task", n) for k, n in enumerate(ns)} and {str(k): G.Node(str(k), "task", n) for k, n in enumerate(ns)}, [G.Edge("f", "0", "1")])])
    got = dict(G.f1_at(names("check the order", "send"), names("check order now", "send"), (0.9, 0.5)))
    assert got == {0.9: 0.0, 0.5: 1.0} and dict(G.f1_at(names("a", "b"), None, (0.5,))) == {0.5: 0.0}
