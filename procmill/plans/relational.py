"""Queues, histories, joins, windows and set operations on the project's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from procmill.operators import relational as O
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


def _t(spark: SparkSession, d: str, *names: str):
    out = [table(spark, d, n) for n in names]
    return out[0] if len(out) == 1 else out


# ---- projections and filters ----

@query("SELECT source, stage, count(*) AS n, CAST(sum(CASE WHEN parse_ok = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_parsed, CAST(sum(CASE WHEN xsd_ok = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM samples GROUP BY ALL")
def group_counts(spark, d):
    return _t(spark, d, "samples").groupBy("source", "stage").agg(F.count("*").alias("n"), F.sum(O.flag(F.col("parse_ok") == 1)).alias("n_parsed"), F.sum(O.flag(F.col("xsd_ok") == 1)).alias("n_valid"))


@query("SELECT id, source, stage FROM samples WHERE source = 'handbook' AND stage IN ('seeds') AND length(trim(raw_text, ' ')) > 0")
def filter_params_not_blank(spark, d):
    return O.where_set(_t(spark, d, "samples"), source="handbook", stage=("seeds",), split=None).where(O.not_blank("raw_text")).select("id", "source", "stage")


@query("SELECT id, variant, score FROM gold_models WHERE score IS NULL OR score >= 4.0")
def admitted_references(spark, d):
    return _t(spark, d, "gold_models").where("score is null or score >= 4.0").select("id", "variant", "score")


@query("SELECT id FROM gold_models WHERE lower(gold_xml) LIKE '%messageflow%' OR source_file ILIKE 'zenodo%'")
def like_filters(spark, d):
    return _t(spark, d, "gold_models").where(F.lower("gold_xml").contains("messageflow") | O.prefixed("source_file", "zenodo")).select("id")


@query("""SELECT a.id, a.model FROM (SELECT DISTINCT id, sample_id, model FROM preprocessing_generations) a
WHERE EXISTS (SELECT 1 FROM json_bpmn_generations b WHERE a.sample_id = b.sample_id AND a.model IS NOT DISTINCT FROM b.model)""")
def null_safe_match(spark, d):
    a, b = _t(spark, d, "preprocessing_generations", "json_bpmn_generations")
    a = a.select("id", "sample_id", "model").distinct()
    return a.join(b.select(F.col("sample_id").alias("s"), F.col("model").alias("m")), (F.col("sample_id") == F.col("s")) & F.col("model").eqNullSafe(F.col("m")), "left_semi").select("id", "model")


@query("SELECT stage, round(avg(CASE WHEN status = 'succeeded' THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_ok, round(avg(length(output_text)), 6) AS mean_chars FROM preprocessing_generations GROUP BY stage ORDER BY stage")
def rolled_up_rates(spark, d):
    x = _t(spark, d, "preprocessing_generations")
    return x.groupBy("stage").agg(F.round(F.avg(O.flag(F.col("status") == "succeeded")) * 100, 6).alias("pct_ok"), F.round(F.avg(F.length("output_text")), 6).alias("mean_chars")).orderBy("stage")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 90")
def json_field_filter(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return _t(spark, d, "events").select("event_id", k.alias("k")).where("k > 90")


@query("SELECT DISTINCT sample_id FROM json_bpmn_generations WHERE status = 'succeeded' AND sample_id IS NOT NULL AND sample_id NOT IN (SELECT record_key FROM deleted_records WHERE table_name = 'samples')")
def leak_exclusion(spark, d):
    g, x = _t(spark, d, "json_bpmn_generations", "deleted_records")
    return g.where("status = 'succeeded' and sample_id is not null").join(x.where("table_name = 'samples'").select(F.col("record_key").alias("sample_id")), "sample_id", "left_anti").select("sample_id").distinct()


# ---- queues ----

@query("SELECT DISTINCT s.id, s.source FROM samples s WHERE NOT EXISTS (SELECT 1 FROM preprocessing_generations g WHERE g.sample_id = s.id)")
def queue_anti_join(spark, d):
    s, g = _t(spark, d, "samples", "preprocessing_generations")
    return O.pending(s.select("id", "source").distinct(), g.select(F.col("sample_id").alias("id")), ["id"])


_QUEUE = """SELECT g.id, g.sample_id FROM (SELECT DISTINCT id, sample_id FROM json_bpmn_generations WHERE status = 'succeeded') g
WHERE NOT EXISTS (SELECT 1 FROM dsl_transpiler_runs r WHERE r.source_generation_id = g.id AND r.transpiler_version = 'json_to_dsl_v10_en' {})"""


def _queue(spark, d, retry):
    g, r = _t(spark, d, "json_bpmn_generations", "dsl_transpiler_runs")
    work = g.where("status = 'succeeded'").select("id", "sample_id").distinct()
    return O.pending_runs(work, r.select(F.col("source_generation_id").alias("id"), "status", F.col("transpiler_version").alias("version")), ["id"], "json_to_dsl_v10_en", retry)


@query(_QUEUE.format(""))
def queue_versioned(spark, d):
    return _queue(spark, d, False)


@query(_QUEUE.format("AND r.status = 'succeeded'"))
def queue_retry_failed(spark, d):
    return _queue(spark, d, True)


@query("""SELECT DISTINCT s.id FROM samples s WHERE EXISTS (SELECT 1 FROM preprocessing_generations g WHERE g.sample_id = s.id AND (g.status = 'failed' OR g.output_text IS NULL))
OR NOT EXISTS (SELECT 1 FROM preprocessing_generations g WHERE g.sample_id = s.id AND g.status IN ('succeeded', 'pending'))""")
def queue_retry_or(spark, d):
    s, g = _t(spark, d, "samples", "preprocessing_generations")
    return O.pending_or_retry(s.select("id").distinct(), g, "id", (F.col("status") == "failed") | F.col("output_text").isNull(), F.col("status").isin("succeeded", "pending"), "sample_id")


@query("""SELECT i.sample_id, i.variant, CAST(r.rep AS INTEGER) AS rep FROM gold_models i CROSS JOIN (SELECT unnest([0, 1, 2]) AS rep) r
WHERE NOT EXISTS (SELECT 1 FROM (SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY id, created_at, status)) - 1 AS rep FROM json_bpmn_generations) x WHERE x.sample_id = i.sample_id AND x.rep = r.rep)""")
def queue_item_repetitions(spark, d):
    g, i = _t(spark, d, "json_bpmn_generations", "gold_models")
    done = g.select("sample_id", (F.row_number().over(W.partitionBy("sample_id").orderBy("id", "created_at", "status")) - 1).alias("rep"))
    return O.repetitions_pending(i.select("sample_id", "variant"), done, ["sample_id"], 3).select("sample_id", "variant", "rep")


# ---- latest, pruning, materialising ----

@query("""SELECT sample_id, id, status FROM (SELECT DISTINCT sample_id, id, status, row_number() OVER (PARTITION BY sample_id ORDER BY id DESC, created_at, status) AS n FROM json_bpmn_generations WHERE sample_id IS NOT NULL) WHERE n = 1""")
def latest_per_key(spark, d):
    return O.latest(_t(spark, d, "json_bpmn_generations").where("sample_id is not null"), ["sample_id"], [F.col("id").desc(), F.col("created_at"), F.col("status")]).select("sample_id", "id", "status")


_MARK = "SELECT *, count(*) OVER w AS n, max(CASE WHEN status <> 'failed' THEN id END) OVER w AS keep FROM preprocessing_generations WINDOW w AS (PARTITION BY sample_id, prompt_version, model)"


@query(f"SELECT id, sample_id, status FROM ({_MARK}) WHERE NOT (n > 1 AND keep IS NOT NULL AND id <> keep)")
def prune_kept(spark, d):
    return O.prune(_t(spark, d, "preprocessing_generations"), ["sample_id", "prompt_version", "model"])[0].select("id", "sample_id", "status")


@query(f"SELECT id, sample_id, status FROM ({_MARK}) WHERE n > 1 AND keep IS NOT NULL AND id <> keep")
def prune_removed(spark, d):
    return O.prune(_t(spark, d, "preprocessing_generations"), ["sample_id", "prompt_version", "model"])[1].select("id", "sample_id", "status")


@query("""WITH s AS (SELECT DISTINCT id, source, dsl FROM samples), r AS (SELECT sample_id, arg_max(output_dsl, id) AS new_dsl FROM dsl_transpiler_runs WHERE status = 'succeeded' AND transpiler_version = 'json_to_dsl_v10_en' AND output_dsl IS NOT NULL GROUP BY sample_id)
SELECT s.id, s.source, coalesce(r.new_dsl, s.dsl) AS dsl FROM s LEFT JOIN r ON r.sample_id = s.id""")
def materialise_state(spark, d):
    s, r = _t(spark, d, "samples", "dsl_transpiler_runs")
    new = r.where("status = 'succeeded' and transpiler_version = 'json_to_dsl_v10_en' and output_dsl is not null").groupBy(F.col("sample_id").alias("id")).agg(F.max_by("output_dsl", "id").alias("dsl"))
    return O.update(s.select("id", "source", "dsl").distinct(), new, ["id"], ["dsl"])


@query("SELECT r.id, j.id AS generation_id, r.status FROM (SELECT DISTINCT id, source_generation_id, status, transpiler_version FROM dsl_transpiler_runs) r JOIN (SELECT DISTINCT id FROM json_bpmn_generations) j ON r.source_generation_id = j.id WHERE r.transpiler_version = 'json_to_dsl_v8' AND r.status = 'succeeded'")
def inner_runs_generations(spark, d):
    r, j = _t(spark, d, "dsl_transpiler_runs", "json_bpmn_generations")
    r = r.where("transpiler_version = 'json_to_dsl_v8' and status = 'succeeded'").select("id", "source_generation_id", "status").distinct()
    return r.join(j.select(F.col("id").alias("generation_id")).distinct(), F.col("source_generation_id") == F.col("generation_id")).select("id", "generation_id", "status")


@query("SELECT DISTINCT id, title FROM samples s WHERE EXISTS (SELECT 1 FROM dsl_transpiler_runs r WHERE r.sample_id = s.id AND r.transpiler_version = 'json_to_dsl_v10_en' AND r.parse_ok = 1)")
def semi_join_pairs(spark, d):
    s, r = _t(spark, d, "samples", "dsl_transpiler_runs")
    return s.select("id", "title").distinct().join(r.where("transpiler_version = 'json_to_dsl_v10_en' and parse_ok = 1").select(F.col("sample_id").alias("id")), "id", "left_semi")


# ---- keyed tables ----

_KEYED = "old AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), new AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"


def _keyed(spark, d):
    o = _t(spark, d, "orders")
    one = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return one("O"), one("F")


@query(f"WITH {_KEYED} SELECT k, v FROM old UNION ALL SELECT k, v FROM new WHERE k NOT IN (SELECT k FROM old)")
def insert_or_ignore(spark, d):
    return O.insert_or_ignore(*_keyed(spark, d), ["k"])


@query(f"WITH {_KEYED} SELECT k, v FROM new UNION ALL SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new)")
def insert_or_replace(spark, d):
    return O.insert_or_replace(*_keyed(spark, d), ["k"], "v")


@query(f"WITH {_KEYED}, o2 AS (SELECT k, v, v + 1 AS score FROM old), n2 AS (SELECT k, v, v + 2 AS score FROM new) SELECT n2.k, n2.v, CASE WHEN o2.k IS NULL THEN n2.score ELSE o2.score END AS score FROM n2 LEFT JOIN o2 ON o2.k = n2.k UNION ALL SELECT k, v, score FROM o2 WHERE k NOT IN (SELECT k FROM n2)")
def upsert_keeping_score(spark, d):
    old, new = _keyed(spark, d)
    return O.upsert(old.withColumn("score", F.col("v") + 1), new.withColumn("score", F.col("v") + 2), ["k"], keep=["score"])


@query(f"WITH {_KEYED} SELECT old.k, coalesce(new.v, old.v) AS v FROM old LEFT JOIN new ON new.k = old.k")
def update_by_key(spark, d):
    return O.update(*_keyed(spark, d), ["k"], ["v"])


@query(f"WITH {_KEYED} SELECT old.k, old.v AS old_value, new.v AS new_value FROM old JOIN new ON new.k = old.k WHERE old.v IS DISTINCT FROM new.v")
def replay_changed(spark, d):
    return O.changed(*_keyed(spark, d), ["k"], "v")


@query("""WITH old AS (SELECT id, transpiler_version, status FROM dsl_transpiler_runs WHERE transpiler_version <> 'json_to_dsl_v8'), new AS (SELECT id, transpiler_version, status FROM dsl_transpiler_runs WHERE transpiler_version IN ('json_to_dsl_v7', 'json_to_dsl_v8') AND parse_ok = 1)
SELECT * FROM old WHERE transpiler_version NOT IN (SELECT transpiler_version FROM new) UNION ALL SELECT * FROM new""")
def replace_version_slice(spark, d):
    r = _t(spark, d, "dsl_transpiler_runs").select("id", "transpiler_version", "status", "parse_ok")
    return O.replace_slice(r.where("transpiler_version <> 'json_to_dsl_v8'").drop("parse_ok"), r.where("transpiler_version in ('json_to_dsl_v7', 'json_to_dsl_v8') and parse_ok = 1").drop("parse_ok"), ["transpiler_version"])


@query("SELECT id, model FROM json_bpmn_generations WHERE NOT (coalesce(model, '') LIKE 'base%')")
def delete_by_prefix(spark, d):
    return _t(spark, d, "json_bpmn_generations").where(~F.coalesce("model", F.lit("")).startswith("base")).select("id", "model")


# ---- multisets and set operations ----

def _halves(spark, d):
    """Direct-follows pairs of each user's events, in the first and the second half of the time."""
    e = _t(spark, d, "events")
    e = e.withColumn("nxt", F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("nxt is not null")
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    one = lambda c: e.where(c).groupBy("user_id", F.col("event_type").alias("a"), F.col("nxt").alias("b")).agg(F.count("*").alias("n"))
    return one(~late), one(late)


_HALVES = """e AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, ts FROM events),
x AS (SELECT user_id, a, b, count(*) AS n FROM e WHERE b IS NOT NULL AND ts < TIMESTAMP '2024-01-16' GROUP BY ALL), y AS (SELECT user_id, a, b, count(*) AS n FROM e WHERE b IS NOT NULL AND ts >= TIMESTAMP '2024-01-16' GROUP BY ALL),
z AS (SELECT coalesce(x.user_id, y.user_id) AS user_id, coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(x.n, 0) AS p, coalesce(y.n, 0) AS q FROM x FULL JOIN y ON x.user_id = y.user_id AND x.a = y.a AND x.b = y.b)"""


@query(f"WITH {_HALVES} SELECT user_id, a, b, least(p, q) AS n FROM z WHERE least(p, q) > 0")
def bag_intersection(spark, d):
    return O.bag_intersection(*_halves(spark, d))


@query(f"WITH {_HALVES} SELECT user_id, a, b, p - q AS n FROM z WHERE p > q")
def bag_difference(spark, d):
    return O.bag_difference(*_halves(spark, d))


@query(f"WITH {_HALVES} SELECT user_id, a, b, p + q AS n FROM z")
def bag_sum(spark, d):
    return O.bag_sum(*_halves(spark, d))


@query(f"""WITH {_HALVES}, s AS (SELECT user_id, CAST(sum(p) AS BIGINT) AS n_ref, CAST(sum(q) AS BIGINT) AS n_cand, CAST(sum(least(p, q)) AS BIGINT) AS n_both FROM z GROUP BY user_id),
t AS (SELECT *, CASE WHEN n_cand > 0 THEN n_both / n_cand WHEN n_ref = 0 THEN 1.0 ELSE 0.0 END AS precision, CASE WHEN n_ref > 0 THEN n_both / n_ref WHEN n_cand = 0 THEN 1.0 ELSE 0.0 END AS recall FROM s)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM t""")
def bag_prf(spark, d):
    return O.bag_scores(*_halves(spark, d), ["user_id"])


@query("SELECT DISTINCT sample_id FROM preprocessing_generations WHERE status = 'succeeded' INTERSECT SELECT DISTINCT sample_id FROM json_bpmn_generations WHERE status = 'succeeded'")
def set_intersect(spark, d):
    a, b = _t(spark, d, "preprocessing_generations", "json_bpmn_generations")
    return a.where("status = 'succeeded'").select("sample_id").intersect(b.where("status = 'succeeded'").select("sample_id"))


@query("SELECT sample_id FROM preprocessing_generations EXCEPT SELECT sample_id FROM json_bpmn_generations")
def set_difference(spark, d):
    a, b = _t(spark, d, "preprocessing_generations", "json_bpmn_generations")
    return a.select("sample_id").subtract(b.select("sample_id"))


@query("SELECT sample_id FROM preprocessing_generations WHERE status = 'failed' UNION SELECT sample_id FROM json_bpmn_generations WHERE status = 'failed'")
def set_union(spark, d):
    a, b = _t(spark, d, "preprocessing_generations", "json_bpmn_generations")
    return a.where("status = 'failed'").select("sample_id").union(b.where("status = 'failed'").select("sample_id")).distinct()


@query("SELECT error_type, count(*) AS n FROM dsl_transpiler_runs WHERE error_type IS NOT NULL GROUP BY error_type ORDER BY n DESC, error_type LIMIT 3")
def top_error_types(spark, d):
    return _t(spark, d, "dsl_transpiler_runs").where("error_type is not null").groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type").limit(3)


@query("SELECT id, created_at AT TIME ZONE 'UTC' AS created_at FROM json_bpmn_generations WHERE status = 'pending' ORDER BY id, created_at LIMIT 20")
def ordered_limit(spark, d):
    return _t(spark, d, "json_bpmn_generations").where("status = 'pending'").select("id", "created_at").orderBy("id", "created_at").limit(20)


@query("SELECT DISTINCT trim(w) AS warning, count(*) OVER (PARTITION BY trim(w)) AS n FROM (SELECT unnest(string_split(warnings, '|')) AS w FROM dsl_transpiler_runs WHERE warnings IS NOT NULL)")
def warning_counts(spark, d):
    return _t(spark, d, "dsl_transpiler_runs").where("warnings is not null").select(F.explode(F.split("warnings", r"\|")).alias("w")).groupBy(F.trim("w").alias("warning")).agg(F.count("*").alias("n"))


# ---- windows ----

@query("""SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled
FROM (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS v FROM events)""")
def forward_fill(spark, d):
    e = _t(spark, d, "events").withColumn("v", F.when(F.col("event_type").isin("click", "view"), F.col("event_type")))
    return e.select("event_id", O.fill_both_ways("v", ["user_id"], ["ts", "event_id"]).alias("filled"))


@query("""WITH x AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM x) SELECT user_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS n FROM y GROUP BY ALL""")
def islands(spark, d):
    return O.islands(_t(spark, d, "events"), "event_type", ["user_id"], ["ts", "event_id"]).groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN n = 1 THEN source ELSE source || '_' || n END AS slug FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)")
def first_wins_numbering(spark, d):
    return O.first_wins(_t(spark, d, "documents").select("doc_id", "lang", "source"), "source", ["lang"], ["doc_id"], "slug").select("doc_id", "slug")


@query("""WITH g AS (SELECT source, count(*) AS n, sha1(source) AS h FROM documents GROUP BY source), r AS (SELECT *, sum(n) OVER (ORDER BY h, source ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT source, n, CASE WHEN run - n < (SELECT floor(count(*) * 0.1) FROM documents) THEN 'validation' ELSE 'training' END AS part FROM r""")
def group_split_sha1(spark, d):
    return O.group_split(_t(spark, d, "documents"), "source", 0.1)


@query("SELECT doc_id, CAST(('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) < 2147483648 AS in_half, CAST(('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) < 1073741824 AS in_quarter FROM documents")
def nested_fraction(spark, d):
    x = _t(spark, d, "documents")
    half, quarter = (O.nested_sample(x, "doc_id", f).select("doc_id", F.lit(True).alias(n)) for f, n in ((0.5, "in_half"), (0.25, "in_quarter")))
    return x.select("doc_id").join(half, "doc_id", "left").join(quarter, "doc_id", "left").fillna(False)


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS n FROM documents) WHERE n <= 5")
def stratified_sample(spark, d):
    return O.stratified(_t(spark, d, "documents"), "lang", "doc_id", 5).select("lang", "doc_id")


@query("SELECT sample_id, id AS best_id, variant, score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC NULLS LAST, variant) AS n FROM gold_models) WHERE n = 1")
def best_reference(spark, d):
    return O.best(_t(spark, d, "gold_models"), ["sample_id"], "score", ["variant"]).select("sample_id", F.col("id").alias("best_id"), "variant", "score")


@query("SELECT sample_id, count(*) AS n_refs FROM gold_models WHERE score IS NULL OR score >= 4 GROUP BY sample_id HAVING count(*) >= 2")
def multi_reference_items(spark, d):
    return _t(spark, d, "gold_models").where("score is null or score >= 4").groupBy("sample_id").agg(F.count("*").alias("n_refs")).where("n_refs >= 2")


@query("SELECT a.sample_id, a.variant AS i, b.variant AS j, length(a.gold_xml) - length(b.gold_xml) AS d FROM gold_models a JOIN gold_models b ON a.sample_id = b.sample_id AND a.variant <> b.variant")
def theta_self_join(spark, d):
    g = _t(spark, d, "gold_models").select("sample_id", "variant", F.length("gold_xml").alias("l"))
    return g.alias("a").join(g.alias("b"), (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.variant") != F.col("b.variant"))).select("a.sample_id", F.col("a.variant").alias("i"), F.col("b.variant").alias("j"), (F.col("a.l") - F.col("b.l")).alias("d"))


_BANDS = ((0, 400), (401, 800), (801, 1600), (1601, 6400))


@query("SELECT doc_id, CASE WHEN n_chars BETWEEN 0 AND 400 THEN 'band_0' WHEN n_chars BETWEEN 401 AND 800 THEN 'band_1' WHEN n_chars BETWEEN 801 AND 1600 THEN 'band_2' WHEN n_chars BETWEEN 1601 AND 6400 THEN 'band_3' ELSE 'other' END AS band FROM documents")
def band_mapping(spark, d):
    band = F.lit(None).cast("string")
    for i, (a, b) in reversed(list(enumerate(_BANDS))):
        band = F.when(F.col("n_chars").between(a, b), f"band_{i}").otherwise(band)
    return _t(spark, d, "documents").select("doc_id", F.coalesce(band, F.lit("other")).alias("band"))


@query("SELECT least(CAST(floor(coalesce(n_chars, 0) / 500) AS BIGINT), 9) AS bucket, count(*) AS n FROM documents GROUP BY 1")
def histogram_buckets(spark, d):
    return _t(spark, d, "documents").groupBy(F.least(F.floor(F.coalesce("n_chars", F.lit(0)) / 500), F.lit(9)).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT sample_id, arg_max(id, id) AS last_id, arg_max(status, id) AS last_status FROM (SELECT DISTINCT sample_id, id, status FROM dsl_transpiler_runs) GROUP BY sample_id")
def last_edge_wins(spark, d):
    x = _t(spark, d, "dsl_transpiler_runs").select("sample_id", "id", "status").distinct()
    return x.groupBy("sample_id").agg(F.max("id").alias("last_id"), F.max_by("status", "id").alias("last_status"))
