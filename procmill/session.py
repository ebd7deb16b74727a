"""Session helpers: building a session, shipping the package to executors, and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import gc
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def build(master: str | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session with the settings that every query here assumes (UTC, AQE, Arrow); the cluster's own settings win where it sets them."""
    b = SparkSession.builder.appName("procmill")
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    return b.config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes the package importable on every executor, whether or not it is installed there. Once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_procmill_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="procmill-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    (folder / "procmill_shipped.zip").write_bytes(buffer.getvalue())
    sc.addPyFile(str(folder / "procmill_shipped.zip"))
    sc._procmill_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a temporary one of our own, but in local mode only: executors on
    other machines could not read it, so a cluster without the setting is refused."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError(f"spark.checkpoint.dir is unset on {sc.master}: intermediate tables need a folder that every executor can read")
    own = getattr(sc, "_procmill_folder", None)
    if own is None:
        own = sc._procmill_folder = tempfile.mkdtemp(prefix="procmill-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def _filesystem(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a file or folder is there. Errors of the file system are raised, not taken for an answer."""
    fs, path = _filesystem(spark, folder)
    return fs.exists(path)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _filesystem(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)]


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = _filesystem(spark, folder)
    fs.delete(path, True)


def own_folder(spark: SparkSession) -> str:
    """This session's part of the shared folder; the file system deletes it when the driver's JVM ends."""
    sc = spark.sparkContext
    own = getattr(sc, "_procmill_own", None)
    if own is None:
        own = sc._procmill_own = os.path.join(shared_folder(spark), "procmill", f"{sc.applicationId}-{uuid.uuid4().hex[:8]}")
        fs, path = _filesystem(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table of the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = os.path.join(own_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._procmill_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more, and lets go of the shuffle files of finished queries: Spark keeps
    these until the driver's JVM happens to collect its garbage."""
    for t in tables:
        remove(t.sparkSession, t._procmill_path)
    drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    gc.collect()
    spark._jvm.System.gc()


def clear_tables(spark: SparkSession) -> None:
    """Deletes the tables that this session's materialize() has written. Results that still read them can no longer be used."""
    fs, path = _filesystem(spark, own_folder(spark))
    fs.delete(path, True)
    fs.mkdirs(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer parts than the cluster has cores, dealt out evenly before work that is heavy per row; others as they are.

    A file of one row group is one part however many cores wait. Only plans without a shuffle of their own are looked at, so nothing
    runs; a scan that fills the cores is left alone, so large inputs gain no shuffle.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString():
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if plan.execute().getNumPartitions() < want else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder (one file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
