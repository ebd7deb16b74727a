"""Orphan references: every kind, nulls, ties, repeats, merging of states."""

from datetime import datetime as T

from procmill.operators import references as R


def tables(spark):
    refs = spark.createDataFrame([(1, "a", T(2025, 1, 1), "x"), (1, "a", T(2025, 1, 1), "x"), (2, "gone", T(2025, 2, 1), "x"), (3, "never", T(2025, 3, 1), "x"), (4, "late", T(2025, 1, 1), "x"), (5, "late", T(2025, 6, 1), "x"), (6, None, T(2025, 1, 1), "x"), (7, "never", None, "x"), (8, "same", T(2025, 4, 1), "x"), (9, "again", T(2025, 4, 1), "x")], "id long, ref string, at timestamp, target string")
    have = spark.createDataFrame([("a", T(2024, 1, 1)), ("late", T(2025, 5, 1)), ("late", T(2025, 3, 1)), ("same", T(2025, 4, 1)), ("again", T(2024, 1, 1)), (None, None)], "id string, at timestamp")
    log = spark.createDataFrame([("t", "gone", None), ("t", "gone", None), ("t", "again", None), ("other", "never", None), ("t", None, None)], "table_name string, record_key string, deleted_at timestamp")
    return refs, have, log


def run(spark, refs, have, log):
    state = R.key_state(R.reference_deltas(refs, "t", "ref", "at"), R.existence_deltas(have, "t", "id", "at"), R.deletion_deltas(log))
    return {tuple(r) for r in R.orphan_rows([(refs, "r", "id", "ref", "at", "t")], state).collect()}, state


def test_kinds(spark):
    got, state = run(spark, *tables(spark))
    assert got == {("r", 2, "deleted", "2025-02"), ("r", 3, "missing", "2025-03"), ("r", 4, "late", "2025-01"), ("r", 7, "missing", None)}
    assert {(r.key, r.refs) for r in R.current_orphans(state).collect()} == {("gone", 1), ("never", 2)}


def test_empty_tables(spark):
    refs, have, log = (t.limit(0) for t in tables(spark))
    assert run(spark, refs, have, log)[0] == set()


def test_states_merge_like_deltas(spark):
    refs, have, log = tables(spark)
    whole = R.key_state(R.reference_deltas(refs, "t", "ref", "at"), R.existence_deltas(have, "t", "id", "at"), R.deletion_deltas(log))
    first = R.key_state(R.reference_deltas(refs.where("id < 4"), "t", "ref", "at"))
    merged = R.key_state(first, R.reference_deltas(refs.where("id >= 4"), "t", "ref", "at"), R.existence_deltas(have, "t", "id", "at"), R.deletion_deltas(log))
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in whole.collect()}


def test_removed_references_and_rows(spark):
    refs, have, _ = tables(spark)
    gone = have.where("id = 'a'")
    state = R.key_state(R.reference_deltas(refs.where("ref = 'a'"), "t", "ref", "at"), R.existence_deltas(have, "t", "id", "at"), R.existence_deltas(gone, "t", "id", "at", -1))
    assert [r.key for r in R.current_orphans(state).collect()] == ["a"]
    none = R.key_state(state, R.reference_deltas(refs.where("ref = 'a'"), "t", "ref", "at", -1))
    assert R.current_orphans(none).isEmpty()
