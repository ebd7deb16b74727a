"""Streams over the events table, run to the end and read back, with the batch form as SQL; and files written and read again."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from procmill.session import own_folder, ship, table
from procmill.sources import files
from procmill.streaming import queue as Q

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark) -> str:
    return os.path.join(own_folder(spark), f"stream-{uuid.uuid4().hex}")


def _stream(spark, d, name="events"):
    df = table(spark, d, name)
    return spark.readStream.schema(df.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet" if not os.path.isfile(f"{d}/{name}.parquet") else f"{d}/{name}.parq*et")


def _sink(df, spark, mode="append"):
    out = _folder(spark)
    q = df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


@query("SELECT user_id, a, b, count(*) AS n FROM (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY ALL")
def stream_direct_follows(spark, d):
    """Stateful: one event kept per user."""
    ship(spark)
    return _sink(Q.follows_stream(_stream(spark, d)), spark).groupBy("user_id", "a", "b").agg(F.count("*").alias("n"))


@query("SELECT CAST(user_id AS BIGINT) AS user_id, event_id, value * 2 AS doubled FROM events WHERE event_type = 'purchase'")
def stream_queue(spark, d):
    """The work queue on a stream, run twice: the second run finds everything done."""
    ship(spark)
    out = _folder(spark)
    for k in range(2):
        src = _stream(spark, d).where("event_type = 'purchase'").select("user_id", "event_id", "value")
        Q.run_queue(src, f"{out}/results", ["event_id"], lambda df: df.select("user_id", "event_id", (F.col("value") * 2).alias("doubled")), f"{out}/log{k}").awaitTermination()
    return spark.read.parquet(f"{out}/results")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    """The batch form of the windowed counts, with the same code as on a stream."""
    return Q.windowed_counts(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS stop, count(*) AS n FROM y GROUP BY user_id, s""")
def session_windows(spark, d):
    s = Q.sessions(table(spark, d, "events"), gap="6 hours")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("SELECT DISTINCT id, source, title, raw_text, stage FROM samples")
def json_lines_round_trip(spark, d):
    """Samples written as JSON lines and read again, the stage by way of the metadata object."""
    out = _folder(spark)
    s = table(spark, d, "samples").select("id", "source", "title", F.col("raw_text").alias("text"), "stage").distinct()
    files.write_json_lines(s, out)
    r = files.json_lines(spark, out, ["id", "source", "title", "text"])
    return r.select("id", "source", "title", "raw_text", F.get_json_object("metadata", "$.stage").alias("stage"))


@query("SELECT transpiler_version, count(*) AS n FROM (SELECT id, transpiler_version FROM dsl_transpiler_runs WHERE transpiler_version <> 'json_to_dsl_v8' UNION ALL SELECT id, transpiler_version FROM dsl_transpiler_runs WHERE transpiler_version = 'json_to_dsl_v8' AND parse_ok = 1) GROUP BY 1")
def replaced_partitions(spark, d):
    """History appended by version, one version's folder replaced."""
    out = _folder(spark)
    r = table(spark, d, "dsl_transpiler_runs").select("id", "parse_ok", "transpiler_version")
    files.append(r, out, ["transpiler_version"])
    files.replace_partitions(r.where("transpiler_version = 'json_to_dsl_v8' and parse_ok = 1"), out, ["transpiler_version"])
    return spark.read.parquet(out).groupBy(F.col("transpiler_version").cast("string").alias("transpiler_version")).agg(F.count("*").alias("n"))
