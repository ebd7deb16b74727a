"""The deterministic chain, layouts, renderings and perturbations over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmill.operators import graphs as G
from procmill.operators import pipeline as P
from procmill.operators import statistics as S
from procmill.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _models(spark, d):
    """Rows as they are scanned: repeats are dropped from the small results, not from the texts, so no shuffle comes before the work."""
    return table(spark, d, "json_bpmn_generations").where("status = 'succeeded'").select("id", "output_json")


@query()
def transpile_json_dsl(spark, d):
    return P.json_to_dsl(_models(spark, d), ["id"], "output_json").drop("error_traceback").distinct()


@query()
def transpile_json_dsl_xml(spark, d):
    """Both stages, and the XML's direct follows against the JSON's."""
    return P.chain(_models(spark, d), ["id"], "output_json").where("status = 'succeeded'").select("id", "status", "df_exact", "df_f1", "nodes_match").distinct()


@query()
def transpile_json_xml(spark, d):
    return P.json_to_xml(_models(spark, d), ["id"], "output_json").select("id", "status", "error_type", F.length("output").alias("n_chars")).distinct()


@query("SELECT id, transpiler_version, CAST(parse_ok AS INTEGER) AS parse_ok FROM dsl_transpiler_runs WHERE output_dsl IS NOT NULL")
def parse_programs(spark, d):
    """The parser's verdict on stored programs; the SQL side has the verdict stored with them."""
    return P.programs_parse(table(spark, d, "dsl_transpiler_runs").where("output_dsl is not null"), ["id", "transpiler_version"], "output_dsl").select("id", "transpiler_version", "parse_ok")


@query()
def layout_nodes(spark, d):
    return P.layouts(table(spark, d, "samples").where("bpmn_json is not null"), ["id"], "bpmn_json", "json").distinct()


@query()
def neutral_rendering(spark, d):
    return P.renderings(table(spark, d, "gold_models"), ["sample_id", "variant"], "gold_xml", "xml").withColumn("digest", F.sha2("rendering", 256)).select("sample_id", "variant", "digest")


@query()
def perturbed_models(spark, d):
    """Every operator's effect on the reference models: the drop in direct-follows F1."""
    g = table(spark, d, "gold_models").where("variant = 'primary'")
    m = P.mutants(g, ["sample_id", "gold_xml"], "gold_xml", "xml")
    c = G.compared(m, ["sample_id", "operator"], "gold_xml", "xml")
    return c.groupBy("operator").agg(F.count("*").alias("n"), F.round(F.avg("df_f1"), 9).alias("mean_f1"), F.round(F.avg("df_strict_f1"), 9).alias("mean_strict_f1"), F.round(F.avg("nodes_match"), 9).alias("nodes_match"))


@query()
def compression_ratio(spark, d):
    c = P.compression(table(spark, d, "samples"), ["id", "source"], "xml", "dsl").distinct()
    return S.mean_ratio(c, "xml_tokens", "dsl_tokens", ["source"]).select("source", "n", *[F.round(x, 9).alias(x) for x in ("mean_ratio", "median_ratio", "reduction")])
