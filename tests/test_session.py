"""The shared folder, written tables, and dealing out small scans."""

import os
import shutil
import uuid

import pytest

from procmill import session as S


def test_written_tables(spark):
    df = spark.range(10)
    t = S.materialize(df, "x")
    assert t.dtypes == df.dtypes and t.count() == 10 and "procmill" in t.inputFiles()[0]
    folder = S.own_folder(spark).replace("file://", "")
    other = os.path.join(os.path.dirname(folder), f"another-{uuid.uuid4().hex}")
    os.makedirs(os.path.join(other, "x-1"))
    assert os.listdir(folder) and os.path.dirname(folder) == os.path.join(S.shared_folder(spark).replace("file://", ""), "procmill")
    S.clear_tables(spark)
    assert not os.listdir(folder) and os.path.exists(os.path.join(other, "x-1")), "another session's tables stay"
    shutil.rmtree(other)
    assert S.materialize(df.limit(0), "y").count() == 0


def test_small_scans_are_dealt_out(spark):
    d = "/root/testdata/sf0.001"
    small = S.table(spark, d, "samples").select("id")
    assert S.spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    shuffled = small.distinct()
    assert S.spread(shuffled) is shuffled and S.spread(spark.range(0, 100, 1, 64)).rdd.getNumPartitions() == 64


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master, getConf = "spark://host:7077", staticmethod(lambda: {})

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs:/x"}
    assert S.shared_folder(Session()) == "hdfs:/x"
