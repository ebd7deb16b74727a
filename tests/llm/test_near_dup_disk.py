"""Problem 6: what stands on disk at once."""

import os

from procmill import session
from procmill.llm import near_dup


def test_pairs_of_leaders_are_counted_in_slices(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "AT_ONCE", 3)
    rows = [([1, 2, 3], [1, 1, 3]), ([1, 3], [1, 3]), ([2, 3, 4], [1, 3, 4]), ([3, 4], [3, 4]), ([2, 5], [1, 5])]
    few = spark.createDataFrame(rows, "leaders array<bigint>, roots array<bigint>").coalesce(1)
    assert sorted(tuple(r) for r in near_dup._leader_pairs(few, 2).collect()) == [(1, 3), (2, 3), (3, 4)]


def test_tables_are_dropped_once_read(spark):
    rows = [(f"s{g}-{k}", None, " ".join(f"w{g}x{i}" if i != 9 * k else "new" for i in range(60))) for g in range(4) for k in range(3)]
    df = spark.createDataFrame(rows + rows[:2], "id string, title string, raw_text string").coalesce(1)  # two rows stand twice
    got = [tuple(r) for r in near_dup.found(df).collect()]
    assert len(got) == len(set(got)) == 12
    left = {f.rsplit("-", 1)[0] for f in os.listdir(session.own_folder(spark).removeprefix("file:"))}
    assert not left & {"near", "bands", "met", "leaders", "open", "candidates", "members"}, left
