"""The registered statistics over all rows and all resamples, on small tables worked out by hand."""

import hashlib
import statistics

import pytest

from procmill.plans import statistics as P
from tools.compare import compare, duck

KIND = "l_returnflag string, l_linestatus string, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_discount double, l_tax double, l_extendedprice double"


def folder(spark, tmp_path, rows):
    """rows: (arm, item, repetition, quantity, score, price)"""
    spark.createDataFrame([(a, "F", i, n, q, v, 0.0, p) for a, i, n, q, v, p in rows], KIND).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_spread_is_across_repetitions(spark, tmp_path):
    d = folder(spark, tmp_path, [("A", 1, 1, 9.0, 0.1, 1.0), ("A", 1, 2, 9.0, 0.4, 1.0), ("A", 1, 7, 9.0, 0.2, 1.0), ("A", 2, 3, 9.0, 0.2, 1.0), ("A", 2, 4, 9.0, 0.2, 1.0), ("A", 3, 5, 9.0, 0.9, 1.0)])
    assert [tuple(r) for r in P.spread_per_item(spark, d).collect()] == [("A", 2, 0.3, 1)]


def test_cluster_bootstrap_reads_every_repetition(spark, tmp_path):
    d = folder(spark, tmp_path, [("A", 1, n, float(n), 0.1, p) for n, p in zip((1, 2, 3, 7), (1.0, 2.0, 4.0, 3.0))])
    got = P.cluster_bootstrap(spark, d).collect()
    assert got and all((r.n, r.rho) == (4, pytest.approx(0.8)) for r in got)  # one cluster: every resample is the table


def picks(seed, b, n):
    return [int(hashlib.md5(f"{seed}-{b}-{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]


def test_registered_intervals_are_of_10_000_resamples(spark, tmp_path):
    d = folder(spark, tmp_path, [(a, i, 1, 9.0, v, 1.0) for i in range(7) for a, v in (("A", i * i / 8), ("R", 0.0))])
    draws = [[i * i / 8 for i in picks(42, b, 7)] for b in range(10_000)]
    means, medians = (sorted(map(f, draws)) for f in (statistics.fmean, statistics.median))
    assert tuple(P.bootstrap_mean_ci(spark, d).first()) == pytest.approx((means[250], means[9749]), abs=1e-9)
    assert tuple(P.bootstrap_median_ci(spark, d).first()) == (medians[250], medians[9750])
    r = P.contrast_rows(spark, d).first()
    assert (r.diff + r.up, r.diff - r.down) == pytest.approx((means[9749], means[250]), abs=1e-8)
    assert P.equivalence_verdict(spark, d).first().verdict == "superior"


def test_rho_of_weighted_clusters_and_its_interval(spark, tmp_path):
    rows = [(i, float(x), float(y)) for i, x, y in [(1, 1, 5), (1, 2, 5), (2, 2, 7), (2, 3, 6), (3, 3, 1), (3, 1, 1), (4, 4, 2), (5, 4, 9)]]
    d = folder(spark, tmp_path, [("A", i, 1, x, 0.1, y) for i, x, y in rows])
    got = {r.b: (r.n, r.rho) for r in P.cluster_bootstrap(spark, d).collect()}
    want = {}
    for b in range(10_000):
        drawn = [r for k in picks(7, b, 5) for r in rows if r[0] == k + 1]
        rank = lambda v: [sum(o < x for o in v) + (v.count(x) + 1) / 2 for x in v]
        a, c = rank([r[1] for r in drawn]), rank([r[2] for r in drawn])
        if len(set(a)) > 1 and len(set(c)) > 1:
            want[b] = (len(drawn), statistics.correlation(a, c))
    assert len(want) < 10_000 and got.keys() == want.keys() and all(got[b] == (n, pytest.approx(rho, abs=1e-8)) for b, (n, rho) in want.items())
    kept = sorted(rho for _, rho in want.values())
    assert tuple(P.cluster_bootstrap_ci(spark, d).first()) == pytest.approx((kept[int(0.025 * len(kept))], kept[int(0.975 * len(kept)) - 1]), abs=1e-8)


@pytest.mark.parametrize("name", ["bootstrap_mean_ci", "bootstrap_median_ci", "equivalence_verdict", "contrast_rows"])
def test_the_first_200_resamples_are_those_of_the_sql(spark, monkeypatch, name):
    monkeypatch.setattr(P, "TIMES", 200)
    d = "/root/testdata/sf0.001"
    assert compare(spark, duck(d), d, name, P.QUERIES[name], P.SQL[name]).endswith("rows equal")
