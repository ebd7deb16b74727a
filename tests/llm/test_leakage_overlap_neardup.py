"""Problems 1, 5 and 6 against brute force on small tables with every odd case, and on the sample data."""

import random
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from procmill.llm import components as CC
from procmill.llm import cross_split, leakage, near_dup
from procmill.llm.words import shingles, word_spans, words

KIND = "id string, split string, source string, title string, raw_text string, cls string, n int, a string, shingles string"
W = [f"word{i}" for i in range(400)]


def text(a, b):
    return " ".join(W[a:b])


ODD = [
    ("t1", "sft", text(0, 60)), ("t2", " SFT ", text(0, 60).upper()), ("t2", " SFT ", text(0, 60).upper()), ("t3", "sft", "x " * 30 + text(100, 119) + " y " * 9), ("t4", "sft", "x " * 30 + text(100, 120).replace(" ", ", ") + " y " * 9),
    ("t5", "sft", None), ("t6", "sft", "   "), ("t7", "sft", ""), ("t8", None, text(0, 60)), ("t9", "sft", text(200, 260) + " extra"), ("t10", "sft", "wórd&nbsp;" + text(300, 340)), (None, "sft", text(0, 60)),
    ("h1", "holdout", text(0, 60)), ("h2", "Holdout", text(90, 130)), ("h3", "validation", text(200, 260)), ("h4", "holdout", text(0, 19)), ("h5", "holdout", None), ("h6", "holdout", text(0, 60)), ("h7", "holdout", "same " * 50), ("t11", "sft", "same " * 25),
    ("t12", "holdout", text(0, 60)), ("t12", "sft", text(0, 60)), ("h8", "holdout", "W​ord " + " ".join("".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in w) for w in W[300:345])), ("L", "sft", text(0, 400) * 3), ("h9", "holdout", text(350, 400)),
]


def frame(spark, rows=ODD):
    return spark.createDataFrame([(i, s, "src", None if k % 2 else "Title", t, "x", 1, "y", "z") for k, (i, s, t) in enumerate(rows)], KIND)


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def brute(rows):
    rows = [(i, (s or "").strip().lower(), words(t or ""), words(h or "")) for i, s, h, t in rows if i is not None]
    sh = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    p1, p5, links = set(), set(), set()
    runs = defaultdict(set)
    for i, s, w, _ in rows:
        if s == "holdout":
            for k in range(len(w) - 19):
                runs[tuple(w[k : k + 20])].add(i)
    for i, s, w, _ in rows:
        if s == "sft":
            p1 |= {(min(i, o), max(i, o)) for k in range(len(w) - 19) for o in runs.get(tuple(w[k : k + 20]), ()) if o != i}
    full = [(i, s, sh(w), sh(h + w)) for i, s, w, h in rows if len(w) >= 20]
    inv, inv6 = defaultdict(set), defaultdict(set)
    for k, (_, _, a, b) in enumerate(full):
        for g in a:
            inv[g].add(k)
        for g in b:
            inv6[g].add(k)
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for k, (i, s, a, b) in enumerate(full):
        for o in {o for g in a for o in inv[g] if o > k}:
            j, t = full[o][:2]
            if i != j and {s, t} in ({"sft", "holdout"}, {"sft", "validation"}) and jac(a, full[o][2]) >= 0.8:
                p5.add((min(i, j), max(i, j)))
        for o in {o for g in b for o in inv6[g] if o > k}:
            if jac(b, full[o][3]) >= 0.6:
                up[root(i)] = root(full[o][0])
    groups = defaultdict(set)
    for x in list(up):
        groups[root(x)].add(x)
    return p1, p5, {(x, y) for g in groups.values() for x in g for y in g if x < y}


def pairs(df):
    rows = [tuple(r) for r in df.select("id_a", "id_b").collect()]
    assert len(rows) == len(set(rows)) and all(a < b for a, b in rows)
    return set(rows)


def test_odd_cases(spark):
    df = frame(spark)
    want = brute([(i, s, None if k % 2 else "Title", t) for k, (i, s, t) in enumerate(ODD)])
    got = pairs(leakage.found(df)), pairs(cross_split.found(df)), pairs(near_dup.found(df))
    assert got == want
    assert ("h2", "t4") in got[0] and ("h2", "t3") not in got[0] and ("h9", "L")[::1] and ("L", "h9") in got[0] and ("h8", "t10") in got[0]


def test_sample_data(spark):
    d = "/root/testdata/sf0.001/samples.parquet"
    rows = [(r["id"], r["split"], r["title"], r["raw_text"]) for r in pq.read_table(d, columns=["id", "split", "title", "raw_text"]).to_pylist()]
    df = spark.read.parquet(d)
    assert (pairs(leakage.found(df)), pairs(cross_split.found(df)), pairs(near_dup.found(df))) == brute(rows)


def test_empty_tables(spark):
    df = frame(spark, []) if False else frame(spark).limit(0)
    assert not pairs(leakage.found(df)) and not pairs(cross_split.found(df)) and not pairs(near_dup.found(df)) and cross_split.report(df).count() == 0 and near_dup.group_report(df).count() == 0 and leakage.spans(df).count() == 0
    only = frame(spark).where("split = 'holdout'")
    assert not pairs(leakage.found(only)) and not pairs(cross_split.found(only))


def test_shards_and_pieces_lose_nothing(spark, monkeypatch):
    df = frame(spark)
    t, e = leakage._sides(df)
    want = {tuple(r) for r in leakage.leaked_passages(t, e).select("train_id", "eval_id", "n_words").collect()}
    assert {tuple(r) for r in leakage.leaked_passages(t, e, shard_words=60).select("train_id", "eval_id", "n_words").collect()} == want
    pieces = list(leakage._words_of(20)(iter([])))
    assert pieces == []


def test_long_evaluation_texts_are_cut_with_overlap():
    import pyarrow as pa

    leakage_words = [f"w{i}" for i in range(120_000)]
    b = pa.RecordBatch.from_pydict({"id": ["e"], "text": [" ".join(leakage_words)]})
    got = next(leakage._words_of(20)(iter([b]))).to_pydict()
    assert got["start"] == [0, 50_000, 100_000] and got["words"][0].split()[-19:] == got["words"][1].split()[:19]


def test_spans_point_into_the_original(spark):
    raw = "Intro &amp; <b>" + text(0, 10).upper() + "</b> café​, " + " ".join(W[10:30]) + "! tail"
    df = frame(spark, [("t", "sft", raw), ("h", "holdout", text(0, 10) + " b cafe " + text(10, 30))])
    r = leakage.spans(df).first()
    assert (r.n_words, r.word_at, raw[r.start : r.start + 5], raw[r.stop - 6 : r.stop]) == (32, 2, "WORD0", "word29")


@pytest.mark.parametrize("s", ["Café &eacute;t&eacute; ﬁn", "a​b ­c", "ＡＢ ½", "x&nbspy &lt;z&gt; &#65;&#x42;", "", "straße İ", "näive"])
def test_spans_have_the_same_words(s):
    assert [w for w, _, _ in word_spans(s)] == words(s)


def near_copies(n):
    return [(f"d{i:03}", "sft", " ".join(f"{w}" if k != i % 97 else f"edit{i}" for k, w in enumerate(W[:120]))) for i in range(n)] + [("far", "sft", text(200, 300))]


def test_crowded_buckets_take_the_exact_way(spark):
    rng = random.Random(3)
    chain = [(f"c{i:02}", "sft", " ".join(W[4 * i : 4 * i + 60])) for i in range(40)]  # each like its neighbours only
    mixed = [(f"m{i:02}", "sft", " ".join([*W[300:340], *[f"z{rng.randrange(25)}" for _ in range(14)]])) for i in range(40)]  # one long common part, all ways apart
    rows = near_copies(60) + chain + mixed
    df = frame(spark, rows)
    sets = near_dup.sample_sets(df)
    few, many = ({tuple(r) for r in near_dup.linked(sets, most=m).collect()} for m in (1, 1000))
    assert few == many
    assert pairs(near_dup.found(df)) == brute([(i, s, None if k % 2 else "Title", t) for k, (i, s, t) in enumerate(rows)])[2]


def test_hot_buckets_give_the_same(spark, monkeypatch):
    df = frame(spark, near_copies(60))
    sets = near_dup.sample_sets(df)
    made = near_dup.materialize(sets.rows.select("cls", "shingles").mapInArrow(near_dup._bands(96, 4, 1), "bucket bigint, cls binary"), "b")
    want = {tuple(r) for r in near_dup.buckets_met(made).collect()}
    monkeypatch.setattr(near_dup, "HOT", 20)
    got = [tuple(r) for r in near_dup.buckets_met(made).collect()]
    assert set(got) == want and len(got) == len(want) and {h for _, c, h in got if c == h} == {h for *_, h in got}


def test_near_copies_cost_as_many_comparisons_as_there_are(spark, monkeypatch):
    counted = []
    plain = near_dup.jaccard_pairs
    monkeypatch.setattr(near_dup, "jaccard_pairs", lambda p, *a: counted.append(p.count()) or plain(p, *a))
    for n in (100, 200):
        counted.clear()
        assert len(pairs(near_dup.found(frame(spark, near_copies(n))))) == n * (n - 1) // 2
        assert sum(counted) <= 6 * n, counted


def test_report_counts_what_the_pairs_do(spark):
    rows = [(i, s, t) for i, s, t in ODD if i] + [(f"k{j}", "sft" if j % 2 else "validation", text(0, 60)) for j in range(8)] + [("k1", "holdout", text(0, 60)), ("only", "sft", text(140, 190)), ("only", "holdout", text(140, 190))]
    df = frame(spark, rows)
    p = cross_split.cross_split_pairs(df).collect()
    want = {(s, len({r.eval_id for r in p if r.eval_split == s}), len({r.train_id for r in p if r.eval_split == s}), len({r.eval_id for r in p if r.eval_split == s and r.similarity == 1})) for s in {r.eval_split for r in p}}
    assert {(r.eval_split, r.n_eval, r.n_train, r.n_exact) for r in cross_split.report(df).collect()} == want and want


def test_signature_estimates_similarity():
    import numpy as np

    pi, sigma = near_dup._permutation(1), near_dup._permutation(2)
    a, b = shingles(W[:200], 3), shingles(W[50:250], 3)
    sig = near_dup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 384, pi, sigma)
    assert abs((sig[0] == sig[1]).mean() - len(set(a) & set(b)) / len(set(a) | set(b))) < 0.1


def test_components(spark):
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(80)] + [("x", "y"), ("y", "x"), ("z", "z"), ("x", "y")] + [("hub", f"leaf{i}") for i in range(50)]
    df = spark.createDataFrame(links, "a string, b string")
    got = {r.cls: r.root for r in CC.components(df).collect()}
    assert {got[f"c{i:03}"] for i in range(81)} == {"c000"} and got["x"] == got["y"] == "x" and "z" not in got and {got[f"leaf{i}"] for i in range(50)} == {"hub"}
    assert CC.components(df.limit(0)).count() == 0
