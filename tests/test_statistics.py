"""Tests against values worked out by hand, and the exact tail against enumeration."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from procmill.operators import statistics as S


@pytest.mark.parametrize("d", [[1, 2, 3, 4, -5], [1.5, -2, 3, -4.5, 6, 7], [1], [-1, -2, -3]])
def test_exact_tail(d):
    ranks = {abs(x): i for i, x in enumerate(sorted(d, key=abs), 1)}
    w = sum(ranks[abs(x)] for x in d if x > 0)
    n, mid = len(d), len(d) * (len(d) + 1) / 4
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in product([0, 1], repeat=n)]
    want = sum(abs(s - mid) >= abs(w - mid) - 1e-9 for s in sums) / len(sums)
    assert S.signed_rank_p(n, w, 0) == pytest.approx(min(1, want))


def test_signed_rank(spark):
    df = spark.createDataFrame([(0.1 + 0.2 - 0.3,), (1.0,), (-1.0,), (2.0,), (3.0,), (None,)], "d double")
    r = S.signed_rank(df).first()
    assert (r.n, r.w_plus, r.w_minus, r.ties) == (4, 1.5 + 3 + 4, 1.5, 6) and S.signed_rank_p(0, 0, 0) == 1.0
    assert S.wilcoxon(df).first().p == pytest.approx(S.signed_rank_p(4, 8.5, 6))


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "k string, p double")
    got = {r.k: round(r.p_holm, 6) for r in S.holm(df.where("k <> 'd'"), "p", ["k"]).collect()}
    assert got == {"a": 0.03, "b": 0.06, "c": 0.06}
    assert max(r.p_holm for r in S.holm(df, "p", ["k"]).collect()) == 0.9


def test_medians_and_spread(spark):
    df = spark.createDataFrame([("A", 1, 0.2), ("A", 1, None), ("A", 1, 0.4), ("A", 2, 1.0), ("B", 1, None)], "arm string, item int, v double")
    m = S.item_medians(df, ["arm", "item"], "v")
    assert {(r.arm, r.item): r.median for r in m.collect()} == {("A", 1): 0.2, ("A", 2): 1.0, ("B", 1): 0.0}
    assert [tuple(r) for r in S.item_spread(df, "arm", "item", "v").collect()] == [("A", 1, 0.4, 1)]
    assert [tuple(r) for r in S.paired(m, "arm", "item", "A", "B").collect()] == [(1, 0.2, 0.0, 0.2)]
    assert S.rank_biserial(spark.createDataFrame([(0.0,)], "d double")).first().effect == 0.0


def test_quantiles_and_ranks(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "v double")
    assert tuple(S.quantiles(df, [], "v", [0.0, 0.5, 0.9, 1.0]).first()) == (1.0, 6.0, 10.0, 10.0)
    t = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    assert sorted(r[0] for r in t.select(S.average_rank("v")).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_spearman_and_concordance(spark):
    df = spark.createDataFrame([(1.0, 10.0, "g"), (2.0, 20.0, "g"), (3.0, 15.0, "g"), (1.0, 5.0, "c"), (2.0, 5.0, "c"), (None, 1.0, "c")], "x double, y double, g string")
    got = {r.g: r.rho for r in S.spearman(df, "x", "y", ["g"]).collect()}
    assert got["g"] == pytest.approx(0.5) and got["c"] is None
    assert S.concordance(spark.createDataFrame([(1, 0), (1, 1), (0, 1)], "a int, b int"), "a", "b", []).first().concordance == 0.5


def test_bootstrap_is_the_same_every_time(spark):
    v = spark.createDataFrame([(i, float(i % 5)) for i in range(30)], "item int, d double")
    a, b = (S.interval(S.bootstrap(v.repartition(n), "d", "item", 100, 7), 100).first() for n in (1, 5))
    assert tuple(a) == tuple(b) and a.low < 2 < a.high
    say = lambda lo, hi: spark.range(1).select(S.verdict(F.lit(lo), F.lit(hi), 0.5)).first()[0]
    assert [say(-0.4, 0.4), say(0.6, 1.0), say(-1.0, -0.6), say(-0.5, 0.4)] == ["equivalent", "superior", "inferior", "inconclusive"]


def test_exact_ranks(spark):
    import random

    from procmill.operators.ranks import exact_ranks, with_average_rank

    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([0.0, 0.0, 1.0, rng.random(), None])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {(r.k, r.v): (r.n, r.upto, r.total) for r in exact_ranks(df, ["k"], "v").collect()}
    assert len(got) == len({r for r in rows if r[1] is not None})
    for (k, v), (n, upto, total) in got.items():
        same = [x for a, x in rows if a == k and x is not None]
        assert (n, upto, total) == (same.count(v), sum(x <= v for x in same), len(same))
    ranked = with_average_rank(df, ["k"], "v", "r")
    assert ranked.count() == sum(r[1] is not None for r in rows) and exact_ranks(df.limit(0), ["k"], "v").count() == 0
