"""Problems 7, 8 and 9: encoding against the library and its round trip, packing's invariants, exact ranks and kinds."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from procmill.llm import encode, packing, quality
from procmill.llm.trees import fit
from procmill.session import table

E = encode.Encoder()
ODD = ["", " ", "a\x1cb \x85 c", "<|endoftext|> x", "ab" * 5000, " " * 1000 + "x", "漢字かな 🙂🙂👩‍👩‍👧", "​ x", "I'll don't WE'RE 'S", "１２３ ½ Ⅻ", "\n\n\n  \n x\t\ty", "é̈ñ", "\x00\x01", "x" * 60_001, "aaaaaaa", "the the the"]


def library():
    t = Tokenizer.from_file(encode.TOKENIZER)
    t.encode_special_tokens = True
    return t


def test_ids_are_the_librarys():
    t = library()
    texts = ODD + [r["text"] or "" for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist()]
    rng = random.Random(5)
    texts += ["".join(rng.choice("ab c\n'é漢🙂1.") for _ in range(rng.randrange(60))) for _ in range(300)]
    for s, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert E.encode(s) == want.ids and E.decode(want.ids) == s and E.size(s) == len(want.ids)
    assert E.encode(None) == [] and E.size(None) == 0


def test_merges_against_rescanning():
    def plain(piece: bytes):
        ids = [E.first[b] for b in piece]
        while True:
            r = [(E.ranks.get((a << 20) | b, 1 << 60), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
            if not r or min(r)[0] == 1 << 60:
                return tuple(ids)
            rank, i = min(r)
            ids[i : i + 2] = [E.made[rank]]

    rng = random.Random(1)
    for _ in range(300):
        s = "".join(rng.choice("abcde then") for _ in range(rng.randrange(40))).encode()
        assert E.merge(s) == plain(s)


def test_caches_are_bounded():
    e = encode.Encoder(most=50)
    for i in range(500):
        e.encode(f"word{i} x{i}")
    assert len(e.ids) <= 50 and "y" * 300 not in e.ids


def test_token_ids(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (1, "a b", "x", 1), (None, "z", "x", 1)], "doc_id long, text string, ids string, n_tokens int")
    got = sorted(((r.doc_id, r.ids) for r in encode.token_ids(df).collect()), key=str)
    assert got == sorted([(1, [64, 275]), (1, [64, 275]), (2, []), (3, []), (None, [89])], key=str) and encode.token_ids(df.limit(0)).count() == 0


# ---- packing ----

def check(rows, sizes, capacity):
    by, pieces = {}, {}
    for r in rows:
        by.setdefault(r.container_id, []).append(r.n_tokens)
        pieces.setdefault(r.doc_id, []).append(r)
    assert all(sum(v) <= capacity for v in by.values())
    for d, t in sizes.items():
        assert sum(r.n_tokens for r in pieces[d]) == t and (len(pieces[d]) == 1 or t > capacity)
    return len(by)


def test_packing(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, 1, 5, 60, 100, 512, 513, 1500, rng.randrange(1, 400)]) for i in range(3000)}
    df = spark.createDataFrame([*sizes.items(), (None, 5)], "doc_id long, n_tokens int")
    budgets = spark.createDataFrame([("a", 512), ("b", 2048), ("none", None), ("zero", 0), ("a", 512)], "budget_name string, capacity_tokens int")
    rows = packing.packed(df, budgets, block=500).collect()
    for name, cap in (("a", 512), ("b", 2048)):
        n = check([r for r in rows if r.budget_name == name], sizes, cap)
        assert n <= 1.08 * sum(sizes.values()) / cap + 8
    assert {r.budget_name for r in rows} == {"a", "b"}
    assert packing.packed(df.limit(0), budgets).count() == 0 and packing.packed(df, budgets.limit(0)).count() == 0


def test_balanced_is_balanced():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 300) for _ in range(4000)]
    for f in (packing.balanced, lambda s, c: packing.tightest(s, c)):
        where = f(sizes, 2048)
        load = np.bincount(where, weights=sizes)
        assert load.max() <= 2048 and len(load) <= 1.03 * sum(sizes) / 2048 + 2
    cost = np.bincount(packing.balanced(sizes, 2048), weights=[t + packing.ATTENTION * t * t for t in sizes])
    assert cost[:-3].std() / cost[:-3].mean() < 0.03
    assert packing.pack([], 10) == [] and packing.pack([0, 0], 10) == [0, 0] and packing.pack([10, 10], 10) == [0, 1]


# ---- quality ----

def test_statistics():
    s = dict(zip(quality.RANKED, quality.statistics("The clerk checks it.\n- item one\n\na | b | c", frozenset({"the", "it"}))))
    assert s["word_count"] == 9 and s["common_word_share"] == pytest.approx(2 / 9) and s["punct_line_share"] == pytest.approx(1 / 3) and s["n_lines"] == 3 and s["symbol_ratio"] == pytest.approx(2 / 30)
    assert all(x == 0 for t in (None, "", " \n") for x in quality.statistics(t, frozenset()))
    assert all(np.isfinite(quality.statistics(t, frozenset())).all() for t in (*ODD[1:], "?", "\n.\n", "x " * 200_000))


def test_ranks_are_exact(spark):
    """Also where one value is spread over several parts."""
    rng = random.Random(4)
    rows = [(rng.choice(["en", "en", "pt"]), s, rng.choice([0.0, 0.0, 1.5, rng.random(), float("inf")]), k) for s in range(3) for k in range(500)]
    for parts in (1, 7, 40):
        got = quality.ranks(spark.createDataFrame(rows, "lang string, stat int, value double, doc_id long"), parts=parts).collect()
        assert sorted((r.lang, r.stat, r.value, r.doc_id) for r in got) == sorted(rows)
        for r in got:
            same = [x for a, b, x, _ in rows if (a, b) == (r.lang, r.stat)]
            assert (r.n, r.upto, r.total) == (same.count(r.value), sum(x <= r.value for x in same), len(same))
    assert quality.ranks(spark.createDataFrame([], "lang string, stat int, value double, doc_id long")).count() == 0


def test_scores_decide_the_kind(spark):
    """Without the tails of its language a document's kind is another: the trees see nothing else."""
    d = "/root/testdata/sf0.1"
    lab = table(spark, d, "quality_labels")
    x = table(spark, d, "documents").join(lab.select("doc_id").distinct(), "doc_id", "left_semi")
    t = quality.materialize(quality.tails(quality.features(x, table(spark, d, "common_words"))), "t")
    trees = quality.learn(t, lab)
    got = list(quality._whole(iter(t.orderBy("doc_id").toArrow().combine_chunks().to_batches())))
    both, value = np.concatenate([g[3] for g in got]), np.concatenate([g[2] for g in got])
    assert both.shape[1] == 2 * len(quality.RANKED) + 2 and (trees.classes(both) != trees.classes(np.zeros_like(both))).any() and len(value) == x.select("doc_id").distinct().count()


def docs(spark):
    return spark.createDataFrame([(1, "The clerk checks the order and then sends it to the office. " * 3, "en-US", "k"), (2, "- one\n- two\n- three", "EN", "k"), (3, None, None, "k"), (4, "", "", "k"), (5, "a;b;c\n1;2;3\n4;5;6", "pt", "k"), (5, "a;b;c\n1;2;3\n4;5;6", "pt", "k"), (6, "{\"a\": 1}", "de", "k"), (None, "x", "en", "k")], "doc_id long, text string, lang string, kind string")


def test_kinds_with_few_or_no_labels(spark):
    words = spark.createDataFrame([("en", "the"), ("en", None), (None, "x")], "lang string, word string")
    labels = spark.createDataFrame([(1, "r", "prose")], "doc_id long, rater string, kind string")
    for given in (labels, labels.limit(0)):
        got = {r.doc_id: r.kind for r in quality.kinds(docs(spark), words, given).collect()}
        assert got == {1: "prose", 2: "list", 3: "junk", 4: "junk", 5: "table", 6: "junk"}
    assert quality.found(docs(spark).limit(0), words, labels).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    lab = table(spark, d, "quality_labels")
    x = table(spark, d, "documents").join(lab.select("doc_id").distinct(), "doc_id", "left_semi")
    train, test = lab.where("doc_id % 2 = 0"), lab.where("doc_id % 2 = 1 and rater = 'rater_1'")
    got = {r.doc_id: r.kind for r in quality.kinds(x, table(spark, d, "common_words"), train).collect()}
    rows = test.collect()
    assert sum(got[r.doc_id] == r.kind for r in rows) / len(rows) >= 0.95


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    m = fit(x[:400], y[:400], 4)
    assert (m.classes(x[400:]) == y[400:]).mean() > 0.95 and (m.classes(x) != 3).all() and len(m.classes(x[:0])) == 0
    assert all(np.array_equal(a[1], b[1]) for a, b in zip(m.trees, fit(x[:400], y[:400], 4).trees))
