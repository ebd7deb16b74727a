"""Every shared passage of a pair is reported, against brute force and with cases worked out by hand."""

import random

from procmill.llm import leakage
from procmill.llm.words import words

W = [f"word{i}" for i in range(400)]


def text(a, b):
    return " ".join(W[a:b])


def sides(spark, train, evaluation):
    return tuple(spark.createDataFrame(rows, "id string, text string") for rows in (train, evaluation))


def runs(a, b, least):
    """(words, place in a, place in b) of every run that goes on neither way."""
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= least:
                    out.add((n, i, j))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("train_id", "eval_id", "n_words", "word_at", "eval_word_at").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_every_passage_of_a_pair(spark):
    raw = text(0, 30) + " between " + text(100, 125) + " and " + text(200, 219) + " then " + text(0, 30)
    r = leakage.leaked_passages(*sides(spark, [("t", raw)], [("h", text(0, 219)), ("copy", text(0, 219))]))
    assert got(r) == {("t", h, n, here, there) for h in ("h", "copy") for n, here, there in [(30, 0, 0), (25, 31, 100), (30, 77, 0)]}
    assert {raw[x.start : x.stop] for x in r.collect()} == {text(0, 30), text(100, 125)}


def test_brute_force(spark):
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    train = [(f"t{k}", make(rng.randrange(90))) for k in range(12)] + [("t0", make(80)), ("t1", "a " * 40)]  # ids with two texts
    evaluation = [(f"h{k}", make(rng.randrange(90))) for k in range(12)] + [("h0", make(80)), ("h1", "a " * 30), ("h2", "a " * 30)]
    want = {(i, h, *r) for i, t in train for h, e in evaluation for r in runs(words(t), words(e), 6)}
    assert got(leakage.leaked_passages(*sides(spark, train, evaluation), least=6)) == want
    assert got(leakage.leaked_passages(*sides(spark, train, evaluation), least=6, shard_words=90)) == want
    assert {tuple(r) for r in leakage.leaked_pairs(*sides(spark, train, evaluation), least=6).collect()} == {r[:2] for r in want}


def test_runs_over_the_borders_of_pieces(spark):
    long = [f"w{i}" for i in range(110_000)]
    train = [("a", " ".join(["x", *long[49_990:50_300], "y", *long[50_010:50_040]])), ("b", " ".join(long[40_000:105_000])), ("c", " ".join(long[49_985:50_019])), ("d", " ".join(long[50_000:50_020]))]
    r = leakage.leaked_passages(*sides(spark, train, [("h", " ".join(long))]))
    assert got(r) == {("a", "h", 310, 1, 49_990), ("a", "h", 30, 312, 50_010), ("b", "h", 65_000, 0, 40_000), ("c", "h", 34, 0, 49_985), ("d", "h", 20, 0, 50_000)}
    assert {x.train_id: (x.start, x.stop) for x in r.collect()}["b"] == (0, len(train[1][1]))


def test_a_full_filter_loses_nothing(spark):
    rng = random.Random(9)
    make = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    train, evaluation = [(f"t{k}", make(60)) for k in range(20)], [(f"h{k}", make(60)) for k in range(20)]
    want = {(i, h) for i, t in train for h, e in evaluation if runs(words(t), words(e), 5)}
    got_pairs = leakage._hits(*sides(spark, train, evaluation), 5, 1000, False, most_bits=512).select("id", "eval_id").distinct()
    assert {tuple(r) for r in got_pairs.collect()} == want and want


def test_a_phrase_that_many_evaluation_texts_share_costs_one_look():
    phrase = [f"p{i}" for i in range(16)]
    pieces = [(str(k).encode(), " ".join([f"a{k}", *phrase, f"b{k}"] + [f"x{k}{i}" for i in range(20)])) for k in range(2000)]
    a = leakage.Automaton(pieces, 20)
    assert a.scan(phrase * 3 + ["end"]) == [] and a.scan([*phrase, "b7", *[f"x7{i}" for i in range(20)]]) == [(b"7", 0, 1, 37)]
    assert max(len(v) for v in a.machine.values() for v in (v.values() if isinstance(v, dict) else [v])) <= 2


def test_filters_miss_no_member(spark):
    import numpy as np

    from procmill.llm.filters import filter_of
    from procmill.llm.words import mix

    members, others = mix(np.arange(5000, dtype=np.uint64)), mix(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64))
    f = filter_of(spark.createDataFrame([(int(x),) for x in members.view(np.int64)], "h long"), 5000)
    assert f.might(members).all() and f.might(others).mean() < 0.01 and not filter_of(spark.createDataFrame([], "h long"), 0).might(others).any()


def test_runs_have_one_hash_wherever_they_stand():
    import numpy as np

    from procmill.llm.words import Runs, hash_words

    a, b = hash_words(W[:50]), hash_words(["x", "y", *W[10:40]])
    assert set(Runs(a).of(7)[10:34].tolist()) <= set(Runs(b).of(7).tolist()) and len(Runs(a).of(51)) == 0 and len(np.unique(Runs(a).of(3))) == 48
