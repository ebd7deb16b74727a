"""The cluster bootstrap over several chunks: rows are packed, never repeated for each block of resamples."""

import hashlib
import random

import pytest

from procmill.operators import statistics as S


def test_md5_of_many_draws_at_once():
    got = S._md5_heads(7, 1234, 12_000)
    assert [int(x) for x in got] == [int(hashlib.md5(f"7-1234-{i}".encode()).hexdigest()[:8], 16) for i in range(12_000)]


@pytest.mark.parametrize("kept", [1 << 24, 20])
def test_chunks_and_blocks_change_nothing(spark, monkeypatch, kept):
    rng = random.Random(5)
    rows = [(rng.randrange(9), float(rng.randrange(6)), float(rng.randrange(4) if rng.random() < 0.5 else rng.randrange(90))) for _ in range(400)]
    df = spark.createDataFrame(rows * 2, "c long, x double, y double")
    monkeypatch.setattr(S, "KEPT", kept)
    seen = []
    plain = S.materialize
    monkeypatch.setattr(S, "materialize", lambda d, name: seen.append((name, plain(d, name))) or seen[-1][1])
    rank = lambda v: (lambda at: [at[x] for x in v])({x: sum(o < x for o in v) + (v.count(x) + 1) / 2 for x in set(v)})
    got = {r.b: (r.n, r.rho) for r in S.cluster_bootstrap_rho(df, "c", "x", "y", 11, 7).collect()}
    for b in range(11):
        w = [int(hashlib.md5(f"7-{b}-{i}".encode()).hexdigest()[:8], 16) % 9 for i in range(9)]
        drawn = [r for k in w for r in rows * 2 if r[0] == k]
        x, y = rank([r[1] for r in drawn]), rank([r[2] for r in drawn])
        m = sum(x) / len(x)
        rho = sum((a - m) * (c - m) for a, c in zip(x, y)) / (sum((a - m) ** 2 for a in x) * sum((c - m) ** 2 for c in y)) ** 0.5
        assert got[b] == (len(drawn), pytest.approx(rho, abs=1e-12))
    assert len(got) == 11
    chunks = dict(seen)["chunks"]
    assert sum(len(r.c) for r in chunks.collect()) <= 400  # equal rows count once, a byte for each cluster
