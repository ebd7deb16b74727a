"""Queues, histories, keyed tables, multisets and windows on small tables with nulls, ties and repeats."""

import pytest
from pyspark.sql import functions as F

from procmill.operators import relational as O


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_queues(spark):
    work = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    done = spark.createDataFrame([(1, "v", "succeeded"), (1, "v", "failed"), (2, "v", "failed"), (3, "old", "succeeded"), (None, "v", "succeeded")], "k int, version string, status string")
    assert rows(O.pending(work, done, ["k"])) == [(None,)]
    assert rows(O.pending_runs(work, done, ["k"], "v")) == [(3,), (None,)]
    assert rows(O.pending_runs(work, done, ["k"], "v", retry_failed=True)) == [(2,), (3,), (None,)]
    assert O.pending_runs(work, done, ["k"], "new").count() == 4
    got = O.pending_or_retry(work.where("k is not null"), done.withColumnRenamed("k", "h"), "k", F.col("status") == "failed", F.col("status") == "succeeded", "h")
    assert rows(got) == [(1,), (2,)]
    assert rows(O.repetitions_pending(spark.createDataFrame([("a",)], "i string"), spark.createDataFrame([("a", 1)], "i string, rep int"), ["i"], 3)) == [("a", 0), ("a", 2)]


def test_prune_keeps_what_it_must(spark):
    h = spark.createDataFrame([(1, "a", None, "failed"), (2, "a", None, "succeeded"), (3, "a", None, "succeeded"), (4, "b", "m", "failed"), (5, "b", "m", "failed"), (6, "c", "m", "failed"), (7, "d", "m", None), (8, "d", "m", "failed")], "id int, s string, model string, status string")
    kept, gone = O.prune(h, ["s", "model"])
    assert [r[0] for r in rows(kept.select("id"))] == [3, 4, 5, 6, 7] and [r[0] for r in rows(gone.select("id"))] == [1, 2, 8]


def test_keyed_tables(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (2, "C"), (3, "c")], "k int, v string")
    assert {r[0] for r in rows(O.insert_or_ignore(old, new, ["k"]))} == {1, 2, 3} and (2, "b") in rows(O.insert_or_ignore(old, new, ["k"]))
    assert rows(O.insert_or_replace(old, new, ["k"], "v")) == [(1, "a"), (2, "C"), (3, "c")]
    one = new.where("v <> 'C'")
    assert rows(O.upsert(old.withColumn("s", F.lit(1)), one.withColumn("s", F.lit(9)), ["k"], keep=["s"])) == [(1, "a", 1), (2, "B", 1), (3, "c", 9)]
    assert rows(O.update(old, one, ["k"], ["v"])) == [(1, "a"), (2, "B")]
    assert rows(O.changed(old, one, ["k"], "v")) == [(2, "b", "B")]
    assert rows(O.replace_slice(old, new, ["k"])) == [(1, "a"), (2, "B"), (2, "C"), (3, "c")]
    assert O.insert_or_ignore(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_bags(spark):
    a, b = spark.createDataFrame([("g", "x", 2), ("g", "y", 1)], "g string, e string, n long"), spark.createDataFrame([("g", "x", 1), ("h", "z", 3)], "g string, e string, n long")
    assert rows(O.bag_intersection(a, b)) == [("g", "x", 1)] and rows(O.bag_difference(a, b)) == [("g", "x", 1), ("g", "y", 1)] and ("h", "z", 3) in rows(O.bag_sum(a, b))
    s = {r.g: r for r in O.bag_scores(a, b, ["g"]).collect()}
    assert (s["g"].precision, round(s["g"].recall, 6), s["g"].f1) == (1.0, 0.333333, 0.5) and (s["h"].precision, s["h"].recall, s["h"].f1) == (0.0, 0.0, 0.0)


def test_windows(spark):
    t = spark.createDataFrame([("u", 1, None), ("u", 2, "a"), ("u", 3, None), ("u", 4, "b"), ("u", 5, "b"), ("v", 1, None)], "k string, i int, c string")
    assert [r[0] for r in t.select(O.fill_both_ways("c", ["k"], ["i"]).alias("f"), "k", "i").orderBy("k", "i").collect()] == ["a", "a", "a", "b", "b", None]
    assert [r[0] for r in O.islands(t, "c", ["k"], ["i"]).orderBy("k", "i").select("island").collect()] == [1, 2, 3, 4, 4, 1]


def test_group_split_and_samples(spark):
    d = spark.createDataFrame([(f"g{i % 37}", i) for i in range(1000)], "g string, i int")
    s = O.group_split(d, "g", 0.1)
    val = s.where("part = 'validation'").agg(F.sum("n")).first()[0]
    assert 100 <= val < 100 + 28 and rows(s) == rows(O.group_split(d.repartition(7), "g", 0.1)) and O.group_split(d.limit(0), "g", 0.1).count() == 0
    small, large = O.nested_sample(d, "i", 0.2), O.nested_sample(d, "i", 0.5)
    assert small.join(large, ["g", "i"], "left_anti").isEmpty() and 130 < small.count() < 270
    assert O.stratified(d, "g", "i", 3).groupBy("g").count().where("count <> 3").isEmpty()


def test_guard(spark):
    a, b = spark.createDataFrame([("x",)], "id string"), spark.createDataFrame([("y",)], "id string")
    O.require_none_shared(a, b, "id")
    with pytest.raises(ValueError):
        O.require_none_shared(a, a, "id")


def test_plans(spark):
    """The strategies that the queries rely on: anti-joins stay anti-joins, filters and columns reach the scan, one window shuffle prunes."""
    from procmill import queries as Q

    d = "/root/testdata/sf0.001"
    plan = lambda n: Q.QUERIES[n](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan("queue_anti_join") and "LeftSemi" in plan("semi_join_pairs")
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,pending)]" in plan("ordered_limit") and "TakeOrderedAndProject" in plan("ordered_limit")
    assert "raw_text" not in plan("group_counts") and plan("prune_kept").count("Exchange hashpartitioning") == 1
