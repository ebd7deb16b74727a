"""Cleaning, scoring and matching of texts, with SQL where DuckDB's expressions can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmill.functions import text as X
from procmill.operators import relational as O
from procmill.session import ship, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sql_count(t: str, pattern: str) -> str:
    flags = "".join(c for c in "im" if pattern.startswith("(?") and c in pattern[2 : pattern.index(")")])
    return f"len(regexp_extract_all({t}, '{pattern[pattern.index(')') + 1 :]}', 0, '{flags}'))"


_P, _A, _R, _C, _N = (_sql_count("coalesce(text, '')", p) for p in (X.PROCESS_WORDS, X.ACTION_WORDS, X.ACTOR_WORDS, X.CONDITION_WORDS, X.NUMBERED_STEP))
_N = "len(regexp_extract_all(coalesce(text, ''), '(?m)^\\s*\\d+\\.\\s+'))"


@query(f"""SELECT doc_id, CAST(least({_P}, 2) + CASE WHEN {_A} >= 8 THEN 3 WHEN {_A} >= 5 THEN 2 WHEN {_A} >= 3 THEN 1 ELSE 0 END + least({_R}, 2) + CASE WHEN {_C} > 0 THEN 1 ELSE 0 END
+ CASE WHEN {_N} >= 3 THEN 2 WHEN {_N} >= 1 THEN 1 ELSE 0 END - CASE WHEN {_sql_count("coalesce(title, '')", X.LEGAL_TITLE)} > 0 THEN 5 ELSE 0 END AS INTEGER) AS score FROM documents""")
def procedural_score(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "title")).select("doc_id", X.procedural_score("text", "title").alias("score"))


@query(f"""WITH x AS (SELECT doc_id, {_N} AS n, {_C} > 0 AS c, len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '{X.CLASS_ACTORS[4:]}', 0, 'i'), lambda v: lower(v)))) >= 2 AS a FROM documents)
SELECT doc_id, CASE WHEN n < 3 THEN 'marginal' WHEN a AND c THEN 'ideal' WHEN a OR c THEN 'good' ELSE 'linear' END AS class FROM x""")
def convertibility(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.convertibility("text").alias("class"))


@query()
def clean_markdown(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.clean_markdown(F.col("text")).alias("cleaned"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g') AS cleaned FROM documents")
def links_and_images(spark, d):
    return table(spark, d, "documents").select("doc_id", X.cut(F.col("text"), "images", "links").alias("cleaned"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '<!--.*?-->', '', 'gs'), '</?[a-zA-Z][^>]*>', '', 'g'), '\{[^}]*\}', '', 'g') AS cleaned FROM documents")
def without_html(spark, d):
    return table(spark, d, "documents").select("doc_id", X.cut(F.col("text"), "html").alias("cleaned"))


@query()
def section_split(spark, d):
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(X.sections(F.col("text"), F.col("title"), 40)).alias("no", "s"))
    return x.select("doc_id", "no", F.col("s.title").alias("section_title"), F.col("s.words").alias("words"))


@query(r"SELECT doc_id, substr(regexp_replace(trim(regexp_replace(lower(title), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s-]', '', 'g')), '[\s-]+', '_', 'g'), 1, 60) AS slug FROM documents")
def slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", X.slug(F.col("title")).alias("slug"))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM documents")
def word_slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_slug(F.col("title")).alias("slug"))


def _split():
    """The split's name without blanks around it, in lower case."""
    return F.lower(F.regexp_replace("split", r"(?U)^\s+|\s+$", ""))


_SPLIT = r"lower(regexp_replace(split, '^\s+|\s+$', '', 'g'))"
_LW = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^0-9a-z]+', ' ', 'g')), ' '), lambda v: v <> ''))"


@query(f"""WITH t AS (SELECT DISTINCT id, source, {_LW.format('title')} AS w FROM samples WHERE title IS NOT NULL AND {_SPLIT} = 'holdout'), u AS (SELECT DISTINCT id, source, {_LW.format('title')} AS w FROM samples WHERE title IS NOT NULL AND {_SPLIT} = 'validation')
SELECT t.id AS a, u.id AS b, round(len(list_intersect(t.w, u.w)) / len(list_distinct(list_concat(t.w, u.w))), 9) AS similarity FROM t JOIN u ON t.source = u.source WHERE len(list_intersect(t.w, u.w)) / len(list_distinct(list_concat(t.w, u.w))) >= 0.2""")
def label_jaccard_align(spark, d):
    """Titles of holdout and validation samples of one source that share a fifth of their words, met through their words."""
    s = table(spark, d, "samples").where("title is not null")
    one = lambda n: s.where(_split() == n).select("id", "source", "title").distinct().withColumn("w", X.label_words(F.col("title")))
    a, b = one("holdout").select(F.col("id").alias("a"), "source", F.col("w").alias("wa")), one("validation").select(F.col("id").alias("b"), "source", F.col("w").alias("wb"))
    hits = a.select("a", "source", F.size("wa").alias("na"), F.explode("wa").alias("w")).join(b.select("b", "source", F.size("wb").alias("nb"), F.explode("wb").alias("w")), ["source", "w"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    sim = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return hits.where(sim >= 0.2).select("a", "b", F.round(sim, 9).alias("similarity"))


_G = "list_filter(string_split(regexp_replace(lower(coalesce(raw_text, '')), '[^0-9a-z]+', ' ', 'g'), ' '), lambda v: v <> '')"


@query(f"""WITH w AS (SELECT DISTINCT id, {_SPLIT} AS split, {_G} AS w FROM samples), g AS (SELECT id, split, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM w WHERE len(w) >= 8),
t AS (SELECT DISTINCT g FROM g WHERE split = 'sft'), e AS (SELECT DISTINCT id, g FROM g WHERE split = 'holdout') SELECT id, count(*) AS n_grams, count(t.g) AS n_shared, round(count(t.g) / count(*), 9) AS share FROM e LEFT JOIN t ON e.g = t.g GROUP BY id HAVING count(t.g) > 0""")
def ngram_contamination(spark, d):
    """The share of every holdout text's distinct runs of 8 words that training texts have too."""
    g = spread(table(spark, d, "samples").select("id", "split", "raw_text")).distinct().select("id", _split().alias("split"), F.explode(X.grams(F.coalesce("raw_text", F.lit("")), 8)).alias("g")).select("id", "split", F.xxhash64("g").alias("g"))
    e, t = g.where("split = 'holdout'").select("id", "g").distinct(), g.where("split = 'sft'").select("g", F.lit(1).alias("hit")).distinct()
    s = e.join(t, "g", "left").groupBy("id").agg(F.count("*").alias("n_grams"), F.count("hit").alias("n_shared")).where("n_shared > 0")
    return s.withColumn("share", F.round(F.col("n_shared") / F.col("n_grams"), 9))


@query(r"WITH t AS (SELECT DISTINCT id, regexp_replace(output_json, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS t FROM json_bpmn_generations WHERE output_json IS NOT NULL) SELECT id, CASE WHEN t LIKE '```%' THEN regexp_replace(regexp_replace(regexp_replace(t, '^```[^\n]*\n?', ''), '\n?```[\s\x0b]*$', ''), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') ELSE t END AS inside FROM t")
def strip_fence(spark, d):
    return table(spark, d, "json_bpmn_generations").where("output_json is not null").select("id", X.without_fence(F.col("output_json")).alias("inside")).distinct()


@query("SELECT id, CASE WHEN length(raw_text) > 200 THEN substr(raw_text, 1, 197) || '...' ELSE raw_text END AS short FROM samples")
def truncate_with_mark(spark, d):
    return table(spark, d, "samples").select("id", X.shortened(F.col("raw_text"), 200).alias("short"))


@query("SELECT id, replace(replace('Text of {source}: {title}', '{source}', coalesce(source, '')), '{title}', coalesce(title, '')) AS prompt, sha256(replace(replace('Text of {source}: {title}', '{source}', coalesce(source, '')), '{title}', coalesce(title, ''))) AS digest FROM samples")
def prompt_fill(spark, d):
    p = X.filled("Text of {source}: {title}", source=F.col("source"), title=F.col("title"))
    return table(spark, d, "samples").select("id", p.alias("prompt"), F.sha2(p, 256).alias("digest"))


@query("SELECT doc_id, string_split(text, ':')[1] AS head FROM documents WHERE text IS NOT NULL")
def prefix_before(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.before(F.col("text"), ":").alias("head"))


@query("SELECT id, coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.source_file') END, id) AS group_key FROM samples")
def group_key(spark, d):
    return table(spark, d, "samples").select("id", F.coalesce(F.get_json_object("metadata", "$.source_file"), F.col("id")).alias("group_key"))


@query(r"SELECT id, regexp_replace(trim(regexp_replace(title, '\s+', ' ', 'g')), '^\"+|\"+$', '', 'g') AS title FROM samples WHERE title IS NOT NULL")
def collapse_space(spark, d):
    return table(spark, d, "samples").where("title is not null").select("id", F.regexp_replace(F.trim(F.regexp_replace("title", r"\s+", " ")), r'^"+|"+$', "").alias("title"))


@query(r"SELECT source, CAST(sum(CASE WHEN regexp_matches(lower(coalesce(raw_text, '')), '(^|[^a-z])(n[ãa]o|processo|quando|at[ée])([^a-z]|$)') THEN 1 ELSE 0 END) AS BIGINT) AS n_marked FROM samples GROUP BY source")
def language_markers(spark, d):
    return table(spark, d, "samples").groupBy("source").agg(F.sum(O.flag(F.lower("raw_text").rlike(r"(^|[^a-z])(n[ãa]o|processo|quando|at[ée])([^a-z]|$)"))).alias("n_marked"))


@query("SELECT id, list_filter(list_transform(string_split(warnings, '|'), lambda v: trim(v)), lambda v: v <> '') AS parts FROM dsl_transpiler_runs WHERE warnings IS NOT NULL")
def list_options(spark, d):
    return table(spark, d, "dsl_transpiler_runs").where("warnings is not null").select("id", X.options(F.col("warnings"), "|").alias("parts"))


@query()
def json_objects(spark, d):
    """The first and the last JSON object in every answer."""
    ship(spark)
    x = table(spark, d, "json_bpmn_generations").where("output_json is not null").select("id", "output_json").distinct()
    return x.select("id", F.sha2(X.first_object_udf("output_json"), 256).alias("first_digest"), F.sha2(X.last_object_udf("output_json"), 256).alias("last_digest"))


@query("SELECT event_id, len(event_type) AS n_prompt, len(event_type) + user_id % 7 AS n_all FROM events WHERE len(event_type) + user_id % 7 <= 10")
def label_mask(spark, d):
    e = table(spark, d, "events").select("event_id", F.array_repeat(F.lit(1), F.length("event_type")).alias("p"), F.array_repeat(F.lit(2), (F.col("user_id") % 7).cast("int")).alias("a"))
    m = e.select("event_id", X.masked_labels(F.col("p"), F.col("a"), 10).alias("m")).where("m is not null")
    return m.select("event_id", F.size(F.filter("m.labels", lambda x: x == -100)).alias("n_prompt"), F.size("m.input_ids").cast("bigint").alias("n_all"))


@query("SELECT source, to_json(list([stage, CAST(n AS VARCHAR)] ORDER BY stage)) AS bag FROM (SELECT source, stage, count(*) AS n FROM samples GROUP BY ALL) GROUP BY source")
def bag_json(spark, d):
    n = O.bag(table(spark, d, "samples"), ["source", "stage"])
    return n.groupBy("source").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("stage", "n"))), lambda x: F.array(x["stage"], x["n"].cast("string")))).alias("bag"))


@query(r"SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '[\s\x0b]+', ' ', 'g'), ' '), lambda v: v <> '')) AS n_words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda v: v != "")).cast("bigint").alias("n_words"))


@query("SELECT event_id, CASE WHEN json_keys(props) = ['k'] AND CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 0 AND 50 THEN 1 ELSE 0 END AS valid FROM events")
def verdict_validation(spark, d):
    """Whether a JSON verdict has exactly the keys it must and a score in range."""
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", O.flag((F.array_sort(F.map_keys(m)) == F.array(F.lit("k"))) & F.expr("try_cast(from_json(props, 'map<string,string>')['k'] as int)").between(0, 50)).alias("valid"))


@query("SELECT id, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.origin') END AS origin, CASE WHEN json_valid(metadata) THEN CAST(json_extract_string(metadata, '$.word_count') AS BIGINT) END AS word_count FROM samples")
def flatten_metadata(spark, d):
    """Fields of a JSON column; what is missing or damaged is null."""
    return table(spark, d, "samples").select("id", F.get_json_object("metadata", "$.origin").alias("origin"), F.get_json_object("metadata", "$.word_count").cast("bigint").alias("word_count"))


@query(f"""WITH p AS (SELECT id, split_part(source_file, '/', 1) AS a, sample_id AS b FROM gold_models), w AS (SELECT id, {_LW.format('a')} AS x, {_LW.format('b')} AS y FROM p), s AS (SELECT id, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS s FROM w)
SELECT count(*) AS n, round(avg(s), 9) AS mean_similarity, round(avg(CASE WHEN s >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS share_matching FROM s""")
def paraphrase_intensity(spark, d):
    """Mean similarity of the pairs in JSON mappings {"mapping": {old: new}}, and the share that still matches."""
    g = table(spark, d, "gold_models").select("id", F.to_json(F.struct(F.create_map(F.substring_index("source_file", "/", 1), F.col("sample_id")).alias("mapping"))).alias("detail"))
    p = g.select("id", F.explode(F.from_json("detail", "struct<mapping:map<string,string>>")["mapping"]).alias("old", "new"))
    s = p.select(X.label_similarity(F.col("old"), F.col("new")).alias("s"))
    return s.agg(F.count("*").alias("n"), F.round(F.avg("s"), 9).alias("mean_similarity"), F.round(F.avg(F.when(F.col("s") >= 0.5, 1.0).otherwise(0.0)), 9).alias("share_matching"))
