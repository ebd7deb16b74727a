"""Calls to a service: order, retries, failures as rows, spacing."""

import sys

from pyspark import cloudpickle

from procmill.operators import calls as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import test modules


def client():
    seen = {}

    def call(p):
        seen[p] = seen.get(p, 0) + 1
        if p == "bad" or (p == "flaky" and seen[p] < 2):
            raise ConnectionError(f"no answer to {p}")
        return p.upper()

    return call


def test_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "flaky"), (3, "bad"), (4, None)], "id int, p string").coalesce(1)
    got = [tuple(r) for r in C.call_rows(df, ["id"], "p", client, tries=2, base=0.001).collect()]
    assert got == [(1, "succeeded", "A", 1, None, None), (2, "succeeded", "FLAKY", 2, None, None), (3, "failed", None, 2, "ConnectionError", "no answer to bad"), (4, "skipped", None, 0, None, None)]
    assert C.call_rows(df.limit(0), ["id"], "p", client).count() == 0


def test_spacing():
    now, slept = [0.0], []
    limit = C.Limiter(10, lambda: now[0], slept.append)
    for _ in range(3):
        limit.turn()
    assert [round(x, 6) for x in slept] == [0.1, 0.2]
    pauses = []
    C.attempt(client(), "bad", 4, 1.0, 1, pauses.append)
    assert len(pauses) == 3 and 0.5 <= pauses[0] <= 1.5 and 2 <= pauses[2] <= 6
