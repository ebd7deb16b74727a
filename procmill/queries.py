"""Queries of the core: name to function of (spark, folder), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from procmill.operators import nested, references as R
from procmill.plans import codecs, graph, relational, statistics, streams, text, validation
from procmill.session import ship, table


# ---- problem 2: nested records ----

def model_docs(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    samples, gens = table(spark, d, "samples"), table(spark, d, "json_bpmn_generations")
    return nested.model_documents([(samples, "samples.bpmn_json", "id", "bpmn_json", "json"), (gens, "json_bpmn_generations.output_json", "id", "output_json", "json"), (samples, "samples.xml", "id", "xml", "xml")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.model_elements(model_docs(spark, d))


def p2_levels(spark: SparkSession, d: str) -> DataFrame:
    """Rows, records and depth of every child table."""
    rows = nested.model_rows(model_docs(spark, d))
    return rows.groupBy("origin", "level").agg(F.count("*").alias("n_rows"), F.countDistinct("record_key").alias("n_records"), F.max("ordinal").alias("max_ordinal"))


# ---- problem 3: references without a target ----

def _reference_tables(spark: SparkSession, d: str):
    pre, gens, runs = (table(spark, d, t) for t in ("preprocessing_generations", "json_bpmn_generations", "dsl_transpiler_runs"))
    referring = [
        (pre, "preprocessing_generations", "id", "sample_id", "created_at", "samples"),
        (gens, "json_bpmn_generations", "id", "sample_id", "created_at", "samples"),
        (runs, "dsl_transpiler_runs", "id", "source_generation_id", "created_at", "json_bpmn_generations"),
    ]
    deltas = [
        *(R.reference_deltas(df, target, key, at) for df, _, _, key, at, target in referring),
        R.existence_deltas(table(spark, d, "samples"), "samples", "id", "created_at"),
        R.existence_deltas(gens, "json_bpmn_generations", "id", "created_at"),
        R.deletion_deltas(table(spark, d, "deleted_records")),
    ]
    return referring, R.key_state(*deltas)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    referring, state = _reference_tables(spark, d)
    return R.orphan_rows(referring, state)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, kind and month."""
    return p3_found(spark, d).groupBy("table_name", "kind", "period").agg(F.count("*").alias("n_rows"))


def p3_orphan_keys(spark: SparkSession, d: str) -> DataFrame:
    """The current state's orphan keys with their number of references."""
    return R.current_orphans(_reference_tables(spark, d)[1]).select("target", "key", F.col("refs").alias("n_refs"), (F.col("deleted_n") > 0).cast("int").alias("deleted"))


_REFS = """
refs AS (
  SELECT 'preprocessing_generations' AS table_name, id AS row_id, 'samples' AS target, sample_id AS key, created_at AS at FROM preprocessing_generations
  UNION ALL SELECT 'json_bpmn_generations', id, 'samples', sample_id, created_at FROM json_bpmn_generations
  UNION ALL SELECT 'dsl_transpiler_runs', id, 'json_bpmn_generations', CAST(source_generation_id AS VARCHAR), created_at FROM dsl_transpiler_runs),
have AS (
  SELECT 'samples' AS target, id AS key, min(created_at) AS first_at FROM samples GROUP BY id
  UNION ALL SELECT 'json_bpmn_generations', CAST(id AS VARCHAR), min(created_at) FROM json_bpmn_generations GROUP BY id),
gone AS (SELECT DISTINCT table_name AS target, record_key AS key FROM deleted_records),
found AS (
  SELECT DISTINCT r.table_name, r.row_id,
    CASE WHEN h.key IS NOT NULL THEN 'late' WHEN g.key IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind,
    strftime(r.at AT TIME ZONE 'UTC', '%Y-%m') AS period
  FROM refs r LEFT JOIN have h ON r.target = h.target AND r.key = h.key LEFT JOIN gone g ON r.target = g.target AND r.key = g.key
  WHERE r.key IS NOT NULL AND (h.key IS NULL OR h.first_at > r.at))
"""

_OWN = {"p2_found": p2_found, "p2_levels": p2_levels, "p3_found": p3_found, "p3_report": p3_report, "p3_orphan_keys": p3_orphan_keys}

_OWN_SQL = {
    "p3_found": f"WITH {_REFS} SELECT table_name, row_id, kind, period FROM found",
    "p3_report": f"WITH {_REFS} SELECT table_name, kind, period, count(*) AS n_rows FROM found GROUP BY ALL",
    "p3_orphan_keys": f"""WITH {_REFS} SELECT r.target, r.key, count(*) AS n_refs, CAST(max(CASE WHEN g.key IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS deleted
FROM refs r LEFT JOIN gone g ON r.target = g.target AND r.key = g.key WHERE r.key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM have h WHERE h.target = r.target AND h.key = r.key) GROUP BY ALL""",
}

PLANS = (relational, statistics, validation, graph, codecs, text, streams)
QUERIES = _OWN | {k: f for m in PLANS for k, f in m.QUERIES.items()}
SQL = _OWN_SQL | {k: q for m in PLANS for k, q in m.SQL.items()}
