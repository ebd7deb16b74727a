"""Process graphs: relations of the models in samples, generations and gold models, and graph operators on event traces, with SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from procmill.operators import graphs as G
from procmill.operators import pipeline as P
from procmill.plans.model_sql import FOLLOWS, STRUCTURE, models, xml_models
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


# ---- models ----

@query(f"WITH {models('samples', 'bpmn_json')} SELECT n.kind, n.cat AS category, count(*) AS n_nodes, count(DISTINCT g.key) AS n_models FROM n JOIN (SELECT DISTINCT rid, key FROM g) g ON g.rid = n.rid GROUP BY ALL")
def model_nodes(spark, d):
    """Nodes of all sample models by kind and category."""
    return G.nodes(table(spark, d, "samples").where("bpmn_json is not null"), ["id"], "bpmn_json", "json").groupBy("kind", "category").agg(F.count("*").alias("n_nodes"), F.countDistinct("id").alias("n_models"))


@query()
def model_edges(spark, d):
    return G.edges(table(spark, d, "samples").where("xml is not null"), ["id"], "xml", "xml").groupBy("id", "process_no").agg(F.count("*").alias("n_edges"), F.count_if(F.col("condition") != "").alias("n_conditional"))


@query(f"WITH RECURSIVE {models('samples', 'bpmn_json')}, {FOLLOWS} SELECT DISTINCT id, a, b, CAST(n AS INTEGER) AS n FROM (SELECT g.key AS id, f.rid, a.label AS a, b.label AS b, count(*) AS n FROM f JOIN act a ON a.rid = f.rid AND a.no = f.no AND a.id = f.a JOIN act b ON b.rid = f.rid AND b.no = f.no AND b.id = f.b JOIN (SELECT DISTINCT rid, key FROM g) g ON g.rid = f.rid GROUP BY ALL)")
def dfg_models(spark, d):
    """The direct-follows bag of every sample model."""
    return G.follows(table(spark, d, "samples").where("bpmn_json is not null"), ["id"], "bpmn_json", "json").distinct()


@query(f"WITH RECURSIVE {xml_models('gold_models', 'gold_xml', 'sample_id, variant')}, {FOLLOWS} SELECT sample_id, variant, a, b, CAST(n AS INTEGER) AS n FROM (SELECT g.sample_id, g.variant, f.rid, a.label AS a, b.label AS b, count(*) AS n FROM f JOIN act a ON a.rid = f.rid AND a.no = f.no AND a.id = f.a JOIN act b ON b.rid = f.rid AND b.no = f.no AND b.id = f.b JOIN g ON g.rid = f.rid GROUP BY ALL)")
def dfg_gold(spark, d):
    return G.follows(table(spark, d, "gold_models"), ["sample_id", "variant"], "gold_xml", "xml")


@query(f"WITH {models('json_bpmn_generations', 'output_json')} SELECT DISTINCT id, category, CAST(n AS INTEGER) AS n FROM (SELECT g.key AS id, n.rid, n.cat AS category, count(*) AS n FROM n JOIN (SELECT DISTINCT rid, key FROM g) g ON g.rid = n.rid WHERE n.cat IS NOT NULL GROUP BY ALL)")
def node_category_bag(spark, d):
    return G.node_categories(table(spark, d, "json_bpmn_generations").where("output_json is not null"), ["id"], "output_json", "json").distinct()


@query("SELECT o_orderkey, a, b, 1 AS n FROM (SELECT o_orderkey, o_orderstatus AS a, coalesce(nullif(o_orderpriority, '5-LOW'), 'p2') AS b FROM orders UNION ALL SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'p2'), '<throw>' FROM orders)")
def message_bag(spark, d):
    """Messages of one small collaboration for each order: from its status to its priority (unnamed if low, so it goes by its id), and on to an event without a name."""
    name = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.concat(F.lit(' name="'), "o_orderpriority", F.lit('"')))
    xml = F.concat(F.lit('<c><participant id="p1" name="'), "o_orderstatus", F.lit('"/><participant id="p2"'), name, F.lit('/><process><intermediateThrowEvent id="t"/></process><messageFlow sourceRef="p1" targetRef="p2"/><messageFlow sourceRef="p2" targetRef="t"/><messageFlow sourceRef="p2"/></c>'))
    return G.messages(table(spark, d, "orders").select("o_orderkey", xml.alias("xml")), ["o_orderkey"], "xml")


@query()
def model_checks(spark, d):
    """Structural findings of every generated model."""
    return G.checks(table(spark, d, "json_bpmn_generations").where("output_json is not null"), ["id"], "output_json", "json").distinct()


@query(f"""WITH RECURSIVE {models('json_bpmn_generations', 'output_json')}, {STRUCTURE}, c AS (SELECT rid, no, count(*) AS n_nodes, CAST(sum(CASE WHEN n_out = 0 AND kind NOT LIKE 'end%' THEN 1 ELSE 0 END) + sum(CASE WHEN n_in = 0 AND kind NOT LIKE 'start%' THEN 1 ELSE 0 END) AS INTEGER) AS n_violations,
CAST(count(*) FILTER (kind LIKE '%Gateway' AND n_out > 1) AS INTEGER) AS n_forks, CAST(count(*) FILTER (kind LIKE '%Gateway' AND n_in > 1) AS INTEGER) AS n_joins, CAST(count(*) FILTER (kind NOT LIKE '%Gateway' AND n_out > 1) AS INTEGER) AS n_implicit_splits FROM d GROUP BY ALL)
SELECT DISTINCT g.key AS id, CAST(g.no - 1 AS INTEGER) AS process_no, CAST(coalesce(c.n_nodes, 0) AS INTEGER) AS n_nodes, CAST((SELECT count(*) FROM e WHERE e.rid = g.rid AND e.no = g.no) AS INTEGER) AS n_edges, CAST((SELECT count(*) FROM e WHERE e.rid = g.rid AND e.no = g.no) - (SELECT count(*) FROM i WHERE i.rid = g.rid AND i.no = g.no) AS INTEGER) AS n_dangling,
st.start, CAST(coalesce(c.n_nodes, 0) - (SELECT count(*) FROM re WHERE re.rid = g.rid AND re.no = g.no) AS INTEGER) AS n_unreachable, CAST(coalesce(cm.n_components, 0) AS INTEGER) AS n_components, coalesce(n_violations, 0) AS n_violations, coalesce(n_forks, 0) AS n_forks, coalesce(n_joins, 0) AS n_joins, coalesce(n_implicit_splits, 0) AS n_implicit_splits
FROM g LEFT JOIN c ON c.rid = g.rid AND c.no = g.no LEFT JOIN st ON st.rid = g.rid AND st.no = g.no LEFT JOIN cm ON cm.rid = g.rid AND cm.no = g.no""")
def model_structure(spark, d):
    """What model_checks finds by edges alone: start, unreachable nodes, connected parts, rule violations, forks, joins, implicit splits."""
    return model_checks(spark, d).drop("n_loops", "n_warnings").distinct()


@query(f"""WITH RECURSIVE {models('samples', 'bpmn_json')}, ek AS (SELECT *, row_number() OVER () AS br FROM e), fk AS (SELECT n.rid, n.no, n.id AS fork, count(*) AS ways FROM n JOIN e ON e.rid = n.rid AND e.no = n.no AND e.s = n.id WHERE n.kind LIKE '%Gateway' GROUP BY ALL HAVING count(*) > 1),
b(rid, no, fork, br, x, lvl) AS (SELECT fk.rid, fk.no, fk.fork, ek.br, ek.t, 0 FROM fk JOIN ek ON ek.rid = fk.rid AND ek.no = fk.no AND ek.s = fk.fork UNION SELECT b.rid, b.no, b.fork, b.br, e.t, b.lvl + 1 FROM b JOIN e ON e.rid = b.rid AND e.no = b.no AND e.s = b.x WHERE e.t <> b.fork AND b.lvl < 60),
m AS (SELECT rid, no, fork, br, x, min(lvl) AS lvl FROM b WHERE x <> fork GROUP BY ALL), c AS (SELECT m.rid, m.no, m.fork, m.x, max(lvl) AS far, count(*) AS met FROM m GROUP BY ALL), best AS (SELECT c.rid, c.no, c.fork, arg_min(c.x, (far, c.x)) AS join_id FROM c JOIN fk ON fk.rid = c.rid AND fk.no = c.no AND fk.fork = c.fork AND fk.ways = c.met GROUP BY ALL)
SELECT DISTINCT g.key AS id, CAST(fk.no - 1 AS INTEGER) AS process_no, fk.fork, best.join_id FROM fk JOIN g ON g.rid = fk.rid AND g.no = fk.no LEFT JOIN best ON best.rid = fk.rid AND best.no = fk.no AND best.fork = fk.fork""")
def join_points(spark, d):
    return G.join_points(table(spark, d, "samples").where("bpmn_json is not null"), ["id"], "bpmn_json", "json").distinct()


def _topology(spark, d):
    s = table(spark, d, "samples").where("bpmn_json is not null and xml is not null")
    return G.compared(s, ["id", "source"], "bpmn_json", "xml", "json", "xml").distinct()  # repeats go after the work: texts are not shuffled


@query()
def topology_pairs(spark, d):
    """Each sample's XML against its JSON."""
    return _topology(spark, d)


@query()
def topology_rollup(spark, d):
    return _topology(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("nodes_match").alias("n_nodes_match"), F.sum("df_exact").alias("n_exact"), F.round(F.avg("df_f1"), 6).alias("mean_f1"), F.round(F.min("df_f1"), 6).alias("min_f1"))


def _gold_pairs(spark, d):
    g = table(spark, d, "gold_models").select("sample_id", "variant", "gold_xml")
    a, b = g.select("sample_id", F.col("variant").alias("i"), F.col("gold_xml").alias("x")), g.select("sample_id", F.col("variant").alias("j"), F.col("gold_xml").alias("y"))
    return G.compared(a.join(b, "sample_id").where("i <> j"), ["sample_id", "i", "j"], "y", "x")


@query()
def expert_agreement(spark, d):
    """Every reference model of an item as a candidate against each other one."""
    return _gold_pairs(spark, d).select("sample_id", "i", "j", "df_f1", "df_strict_f1", "label_share")


@query(f"""WITH RECURSIVE {xml_models('gold_models', 'gold_xml', 'sample_id, variant')}, {FOLLOWS}, bag AS (SELECT f.rid, a.label AS a, b.label AS b, count(*) AS n FROM f JOIN act a ON a.rid = f.rid AND a.no = f.no AND a.id = f.a JOIN act b ON b.rid = f.rid AND b.no = f.no AND b.id = f.b GROUP BY ALL),
sz AS (SELECT g.rid, sample_id, variant, coalesce(sum(n), 0) AS n FROM g LEFT JOIN bag ON bag.rid = g.rid GROUP BY ALL), pr AS (SELECT x.sample_id, x.variant AS i, y.variant AS j, x.n AS nc, y.n AS nr, (SELECT coalesce(sum(least(p.n, q.n)), 0) FROM bag p JOIN bag q ON p.a = q.a AND p.b = q.b WHERE p.rid = x.rid AND q.rid = y.rid) AS met FROM sz x JOIN sz y ON x.sample_id = y.sample_id AND x.variant <> y.variant),
s AS (SELECT *, CASE WHEN nc > 0 THEN met / nc WHEN nr = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN nr > 0 THEN met / nr WHEN nc = 0 THEN 1.0 ELSE 0.0 END AS r FROM pr)
SELECT sample_id, i, j, round(p, 9) AS df_strict_precision, round(r, 9) AS df_strict_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9) AS df_strict_f1, CAST(nr AS INTEGER) AS df_ref_size, CAST(nc AS INTEGER) AS df_cand_size FROM s""")
def strict_agreement(spark, d):
    """Reference models of an item against each other without alignment of labels."""
    return _gold_pairs(spark, d).select("sample_id", "i", "j", *[F.round(c, 9).alias(c) for c in ("df_strict_precision", "df_strict_recall", "df_strict_f1")], "df_ref_size", "df_cand_size")


def _case_pairs(spark, d):
    """An item's primary reference and its perturbed forms, as if several experts had drawn it, each against each other."""
    g = table(spark, d, "gold_models").where("variant = 'primary'")
    c = P.cases(g, ["sample_id"], "gold_xml", "xml").distinct()
    a, b = c.select("sample_id", F.col("kind").alias("i"), F.col("xml").alias("x")), c.select("sample_id", F.col("kind").alias("j"), F.col("xml").alias("y"))
    return G.compared(a.join(b, "sample_id").where("i <> j"), ["sample_id", "i", "j"], "y", "x")  # at most one form for each operator


@query()
def human_ceiling(spark, d):
    """Per item, the mean over its models of the best F1 below 1 against the others, 0 without any."""
    per = _case_pairs(spark, d).groupBy("sample_id", "i").agg(F.coalesce(F.max(F.when(F.col("df_f1") < 1, F.col("df_f1"))), F.lit(0.0)).alias("best"))
    return per.groupBy("sample_id").agg(F.count("*").alias("n_models"), F.round(F.avg("best"), 9).alias("ceiling"))


@query()
def label_ceiling(spark, d):
    """Per model with another of F1 below 1: the label share of the best such pair, ties to the first variant."""
    p = O.latest(_case_pairs(spark, d).where("df_f1 < 1"), ["sample_id", "i"], [F.col("df_f1").desc(), F.col("j")])
    return p.select("sample_id", "i", "j", F.round("label_share", 9).alias("label_share"))


@query()
def score_candidates(spark, d):
    """Each succeeded generation of a sample with gold models against all its admitted ones; the best reference's measures stand."""
    g = table(spark, d, "gold_models").where("score is null or score >= 4").select("sample_id", "variant", "gold_xml")
    c = table(spark, d, "json_bpmn_generations").where("status = 'succeeded'").select("id", "sample_id", "output_json").distinct()
    return G.best_scores(G.compared(c.join(g, "sample_id"), ["id", "sample_id", "variant"], "gold_xml", "output_json", "xml", "json"), ["id"], "variant").select("id", "sample_id", "variant", "df_f1", "df_precision", "df_recall", "nodes_match", "parse_error")


@query()
def alignment_thresholds(spark, d):
    """Mean F1 of reference pairs at several label thresholds."""
    g = table(spark, d, "gold_models").select("sample_id", "variant", "gold_xml")
    p = g.select("sample_id", F.col("variant").alias("i"), F.col("gold_xml").alias("x")).join(g.select("sample_id", F.col("variant").alias("j"), F.col("gold_xml").alias("y")), "sample_id").where("i < j")
    f = G.compared_at(p, ["sample_id", "i", "j"], "y", "x", (0.5, 0.4, 0.3, 0.2, 0.1, 0.01))
    return f.groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.avg("df_f1"), 9).alias("mean_f1"))


# ---- traces ----

def _trace(spark, d):
    return table(spark, d, "events").withColumn("nxt", F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")))


_T = "t AS (SELECT user_id, event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events), e AS (SELECT DISTINCT user_id, source, target FROM t WHERE target IS NOT NULL)"


@query("WITH x AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE event_type <> 'error') SELECT user_id, a, b, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY ALL")
def dfg_events(spark, d):
    """Direct follows of each user's events, with errors only routing."""
    e = table(spark, d, "events").where("event_type <> 'error'").withColumn("b", F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.where("b is not null").groupBy("user_id", F.col("event_type").alias("a"), "b").agg(F.count("*").alias("n"))


def _graphs(spark, d, *kinds: tuple[str, str], keys=("user_id",)):
    """One graph per user (and day): the kinds of events in order of their first, tasks but for `kinds`, and which follow which."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    w = W.partitionBy(*keys).orderBy("ts", "event_id")
    e = e.select(*keys, "event_type", F.lead("event_type").over(w).alias("nxt"), F.row_number().over(w).alias("no"))
    per = e.groupBy(*keys, "event_type").agg(F.min("no").alias("no"), F.collect_set("nxt").alias("nexts"))  # at most the kinds of events squared for each graph
    per = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("no", "event_type", "nexts"))).alias("g"))
    return per.select(*keys, F.to_json(F.struct(F.transform("g", lambda x: x["event_type"]).alias("nodes"), F.flatten(F.transform("g", lambda x: F.transform(F.array_sort(x["nexts"]), lambda t: F.array(x["event_type"], t)))).alias("edges"))).alias("graph")), dict(kinds)


@query(f"""WITH {_T}, o AS (SELECT user_id, source AS node, count(*) AS n_out FROM e GROUP BY ALL), i AS (SELECT user_id, target AS node, count(*) AS n_in FROM e GROUP BY ALL)
SELECT coalesce(o.user_id, i.user_id) AS user_id, coalesce(o.node, i.node) AS node, CASE WHEN n_out > 1 AND n_in > 1 THEN 'both' WHEN n_out > 1 THEN 'fork' WHEN n_in > 1 THEN 'join' ELSE 'none' END AS role FROM o FULL JOIN i ON o.user_id = i.user_id AND o.node = i.node""")
def gateway_degree(spark, d):
    df, kinds = _graphs(spark, d)
    return G.of_edges(df, ["user_id"], "graph", kinds, lambda g: [(i, G.G.gateway_role(g, i)) for i in g.nodes if any(i in (e.source, e.target) for e in g.edges)], "node string, role string")


@query(f"WITH RECURSIVE {_T}, r(user_id, start, node) AS (SELECT user_id, 'signup', target FROM e WHERE source = 'signup' UNION SELECT r.user_id, r.start, e.target FROM r JOIN e ON e.user_id = r.user_id AND e.source = r.node) SELECT user_id, start, node FROM r")
def reachability(spark, d):
    e = _trace(spark, d).where("nxt is not null").select("user_id", F.col("event_type").alias("source"), F.col("nxt").alias("target")).distinct()
    return G.closure(e, e.where("source = 'signup'").select("user_id", F.col("source").alias("start")).distinct(), ["user_id"])


_DAY = "CAST(ts AS DATE) AS day"
_DAYS = f"v AS (SELECT user_id, {_DAY}, event_type, ts, event_id, lead(event_type) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)), e AS (SELECT DISTINCT user_id, day, event_type AS s, nxt AS t FROM v WHERE nxt IS NOT NULL), nd AS (SELECT user_id, day, event_type AS id, min((ts, event_id)) AS pos FROM v GROUP BY ALL)"
_START = "fr AS (SELECT nd.*, EXISTS (SELECT 1 FROM e WHERE e.user_id = nd.user_id AND e.day = nd.day AND e.t = nd.id) AS has_in FROM nd), st AS (SELECT user_id, day, CASE WHEN bool_or(id = 'signup') THEN 'signup' ELSE arg_min(id, pos) FILTER (NOT has_in) END AS start FROM fr GROUP BY ALL)"


@query(f"""WITH RECURSIVE {_DAYS}, {_START}, r(user_id, day, id) AS (SELECT user_id, day, start FROM st WHERE start IS NOT NULL UNION SELECT r.user_id, r.day, e.t FROM r JOIN e ON e.user_id = r.user_id AND e.day = r.day AND e.s = r.id)
SELECT user_id, day, id AS node FROM nd WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = nd.user_id AND r.day = nd.day AND r.id = nd.id)""")
def unreachable_nodes(spark, d):
    """Kinds of events of a user's day that no way leads to from its start."""
    df, kinds = _graphs(spark, d, ("signup", "startEvent"), keys=("user_id", "day"))
    return G.of_edges(df, ["user_id", "day"], "graph", kinds, lambda g: [(i,) for i in G.G.unreachable(g)], "node string")


@query(f"WITH {_DAYS}, {_START} SELECT user_id, day, start FROM st")
def start_pick(spark, d):
    """The start of every user's day: the sign-up, else the first kind of event that follows none."""
    df, kinds = _graphs(spark, d, ("signup", "startEvent"), keys=("user_id", "day"))
    return G.of_edges(df, ["user_id", "day"], "graph", kinds, lambda g: [(G.G.start_of(g),)], "start string")


@query(f"WITH {_T} SELECT e.user_id, e.source, e.source || '_split' AS gateway, count(*) AS n_ways FROM e GROUP BY ALL HAVING count(*) > 1")
def implicit_split(spark, d):
    df, kinds = _graphs(spark, d)

    def f(g):
        new = G.G.split_implicit(g)
        after = new.successors()
        return [(e.source, e.target, len(after[e.target])) for e in new.edges if e.target not in g.nodes]

    return G.of_edges(df, ["user_id"], "graph", kinds, f, "source string, gateway string, n_ways bigint")


@query(f"WITH {_T} SELECT DISTINCT user_id, a, b, 1 AS n FROM (SELECT user_id, source AS a, target AS b FROM e WHERE source <> 'error' AND target <> 'error' UNION SELECT x.user_id, x.source, y.target FROM e x JOIN e y ON x.user_id = y.user_id AND x.target = 'error' AND y.source = 'error' WHERE x.source <> 'error' AND y.target <> 'error')")
def dfg_event_graphs(spark, d):
    """Direct follows of every user's graph of events, through errors."""
    df, kinds = _graphs(spark, d, ("error", "exclusiveGateway"))
    return G.of_edges(df, ["user_id"], "graph", kinds, lambda g: [(a, b, n) for (a, b), n in G.G.direct_follows(g).items()], "a string, b string, n int")


@query(f"WITH {_T} SELECT DISTINCT a.user_id, a.source FROM e a WHERE a.source = a.target")
def self_loops(spark, d):
    return _trace(spark, d).where("nxt = event_type").select("user_id", F.col("event_type").alias("source")).distinct()


@query(f"""WITH {models('(SELECT * FROM samples WHERE raw_text IS NOT NULL)', 'bpmn_json', 'id', ', source, raw_text')}, w AS (SELECT DISTINCT rid, unnest(list_distinct(list_filter(string_split(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g'), ' '), lambda v: v <> ''))) AS w FROM n WHERE cat IS NOT NULL), s AS (SELECT rid, id, source, list_distinct(list_filter(string_split(regexp_replace(lower(raw_text), '[^0-9a-z]+', ' ', 'g'), ' '), lambda v: v <> '')) AS ws FROM (SELECT DISTINCT rid, key AS id, source, raw_text FROM g)),
a AS (SELECT DISTINCT s.id, s.source, n_words, n_anchored FROM (SELECT s.rid, count(*) AS n_words, count(*) FILTER (list_contains(s.ws, w.w)) AS n_anchored FROM w JOIN s ON s.rid = w.rid GROUP BY ALL) c JOIN s ON s.rid = c.rid) SELECT source, count(*) AS n, round(avg(n_anchored / n_words), 9) AS mean_share FROM a GROUP BY source""")
def lexical_anchoring(spark, d):
    """How far model labels use the words of the text they were made from, per source."""
    s = table(spark, d, "samples").where("bpmn_json is not null and raw_text is not null")
    return G.anchoring(s, ["id", "source"], "bpmn_json", "raw_text", "json").distinct().groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("share"), 9).alias("mean_share"))
