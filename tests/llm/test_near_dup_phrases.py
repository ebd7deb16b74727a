"""Problem 6: texts with common phrases, whose buckets hold many leaders of different components."""

import random

from procmill.llm import near_dup


def test_common_phrases_send_few_sets(spark, monkeypatch):
    rng = random.Random(4)
    phrases = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(24)]
    rows = [(f"s{i:03}", None, " ".join(rng.sample(phrases, 5))) for i in range(150)]
    rows += [(f"t{i:03}", None, r[2].rsplit(" ", 1)[0] + " edited") for i, r in enumerate(rows[:20])]
    df = spark.createDataFrame(rows, "id string, title string, raw_text string")
    cut = [{tuple(x.split()[i : i + 3]) for i in range(len(x.split()) - 2)} for _, _, x in rows]
    like = [(a, b) for b in range(len(rows)) for a in range(b) if len(cut[a] & cut[b]) >= 0.6 * len(cut[a] | cut[b])]
    near = sum(len(cut[a] & cut[b]) >= 0.4 * len(cut[a] | cut[b]) for b in range(len(rows)) for a in range(b))
    counted = []
    plain = near_dup.jaccard_pairs
    monkeypatch.setattr(near_dup, "jaccard_pairs", lambda p, *a: counted.append(p.count()) or plain(p, *a))
    roots = {r.id: r.root for r in near_dup.groups(df).collect()}
    assert all(roots[rows[a][0]] == roots[rows[b][0]] for a, b in like)
    assert sum(counted) <= 1.5 * near, (counted, near)


def test_slices_of_verified_pairs_lose_none(spark):
    rows = [(f"s{i:02}", None, " ".join(f"w{k}" for k in range(i, i + 40))) for i in range(30)]
    sets = near_dup.sample_sets(spark.createDataFrame(rows, "id string, title string, raw_text string"), numbered=True)
    c = sets.classes.select("cls")
    pairs = c.withColumnRenamed("cls", "a").crossJoin(c.withColumnRenamed("cls", "b")).where("a < b")
    sketches = sets.classes.mapInArrow(near_dup._sketched, "cls bigint, n int, bits binary")
    want = {tuple(r) for r in near_dup.jaccard_pairs(pairs, sets, 0.4).collect()}
    got = [tuple(r) for r in near_dup._verified(pairs, sets, sketches, 50, 0.4).collect()]
    assert set(got) == want and len(got) == len(want) > 300
