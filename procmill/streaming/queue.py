"""Structured Streaming forms of the work queue, event counts, direct follows and reference counts: the same results as the batch forms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from procmill.operators.references import key_state
from procmill.operators.relational import pending
from procmill.session import exists, names_in, remove


def parquet_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def run_queue(stream: DataFrame, results: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Each micro-batch's rows whose keys have no result yet are worked on and appended to `results` (parquet).

    A batch that is run again after a failure finds its own rows done, so rows are appended once. Within a batch equal keys count once.
    Only a folder that is not there counts as no results; one that cannot be read fails the batch.
    """
    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        todo = df.dropDuplicates(list(keys))
        if exists(spark, results) and any(f[0] not in "._" for f in names_in(spark, results)):
            todo = pending(todo, spark.read.parquet(results), keys)
        work(todo).write.mode("append").parquet(results)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str = "ts", by: str = "event_type", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per tumbling window; rows later than `late` behind the newest are dropped by the watermark."""
    t = stream.withColumn("_at", F.col(at).cast("timestamp"))
    return t.withWatermark("_at", late).groupBy(F.window("_at", width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(stream: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    t = stream.withColumn("_at", F.col(at).cast("timestamp"))
    return t.withWatermark("_at", late).groupBy(F.session_window("_at", gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def follows_stream(stream: DataFrame, user: str = "user_id", at: str = "ts", kind: str = "event_type", tie: str = "event_id") -> DataFrame:
    """(user, a, b): each user's events in order of arrival, paired with the one before; only the last event is kept per user."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values([at, tie])
        last = state.get[0] if state.exists else None
        kinds = rows[kind].tolist()
        pairs = list(zip(([last] if last is not None else []) + kinds, kinds if last is not None else kinds[1:]))
        state.update((kinds[-1],))
        yield pd.DataFrame({user: [key[0]] * len(pairs), "a": [p[0] for p in pairs], "b": [p[1] for p in pairs]})

    return stream.groupBy(user).applyInPandasWithState(step, f"{user} long, a string, b string", "last string", "append", "NoTimeout")


def counts_from_deltas(batches: DataFrame, state_path: str, checkpoint: str, buckets: int | None = None) -> StreamingQuery:
    """Keeps the reference state of operators.references up to date from a stream of deltas: every batch is summed into a new version.

    State v<epoch> is complete once its _SUCCESS is there. A batch goes on from the newest complete version below its epoch, and from
    nothing only if there is none; a version that is there and cannot be read fails the batch, so no state is lost silently. The
    version before the one gone on from is deleted, so two stand at any time. buckets: parts of the state, by key.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        names = names_in(spark, state_path) if exists(spark, state_path) else []
        complete = sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and int(n[1:]) < epoch and written(spark, f"{state_path}/{n}"))
        if epoch > 0 and not complete:
            raise FileNotFoundError(f"batch {epoch} finds no complete state in {state_path}")
        old = [spark.read.parquet(f"{state_path}/v{complete[-1]}")] if complete else []
        state = key_state(*old, df)
        (state.repartition(buckets, "target", "key") if buckets else state).write.mode("overwrite").parquet(f"{state_path}/v{epoch}")
        for v in complete[:-1]:
            remove(spark, f"{state_path}/v{v}")

    return batches.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, folder: str) -> bool:
    """Whether a write to the folder has ended: its _SUCCESS is there."""
    return exists(spark, f"{folder}/_SUCCESS")
