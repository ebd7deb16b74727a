"""Reliability, acceptance and report tables on lineitem and orders read as an experiment: see statistics.py; orders are targets, their lines repetitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmill.operators import graphs as G
from procmill.operators import pipeline as P
from procmill.operators import statistics as S
from procmill.operators import validation as V
from procmill.plans.statistics import _BOOT, _EVAL, _P, _PAIRED, _RANKED, TIMES, _eval, _pairs
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


def _rounded(df, *keep: str, digits: int = 9):
    return df.select(*[c if c in keep else F.round(c, digits).alias(c) for c in df.columns])


_RANK = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0"
_RHO = "CASE WHEN count(DISTINCT {0}) > 1 AND count(DISTINCT {1}) > 1 THEN corr({0}, {1}) END"


def _targets(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    return x.select(F.col("o_custkey").alias("cluster"), F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("rep"), F.col("l_discount").alias("score"), F.round(F.col("o_totalprice") / 5e6, 2).alias("expert"))


@query(f"""WITH s AS (SELECT o_custkey AS cluster, l_orderkey AS target, l_linenumber AS rep, l_discount AS score, round(o_totalprice / 5e6, 2) AS expert FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT cluster, target, median(score) AS judge, max(expert) AS expert, max(score) - min(score) AS d, count(DISTINCT rep) AS n FROM s GROUP BY ALL),
r AS (SELECT cluster, {_RANK.format('1', 'judge')} AS a, {_RANK.format('1', 'expert')} AS b, {_RANK.format('cluster', 'judge')} AS wa, {_RANK.format('cluster', 'expert')} AS wb FROM t),
w AS (SELECT cluster, {_RHO.format('wa', 'wb')} AS rho FROM r GROUP BY cluster),
u AS (SELECT target, max(CASE WHEN rep = 1 THEN score END) AS r1, max(CASE WHEN rep = 2 THEN score END) AS r2, max(CASE WHEN rep = 3 THEN score END) AS r3 FROM s GROUP BY target),
p AS (SELECT 'rho_1_2' AS pair, r1 AS a, r2 AS b FROM u WHERE r1 IS NOT NULL AND r2 IS NOT NULL UNION ALL SELECT 'rho_1_3', r1, r3 FROM u WHERE r1 IS NOT NULL AND r3 IS NOT NULL UNION ALL SELECT 'rho_2_3', r2, r3 FROM u WHERE r2 IS NOT NULL AND r3 IS NOT NULL),
q AS (SELECT pair, {_RANK.format('pair', 'a')} AS a, {_RANK.format('pair', 'b')} AS b FROM p), k AS (SELECT pair, corr(a, b) AS rho FROM q GROUP BY pair)
SELECT (SELECT count(*) FROM t) AS n_targets, (SELECT count(DISTINCT cluster) FROM t) AS n_clusters, (SELECT round(avg(abs(judge - expert)), 9) FROM t) AS mae, (SELECT round(avg(CASE WHEN n > 1 THEN CASE WHEN round(d, 9) <= 0.05 THEN 1.0 ELSE 0.0 END END), 9) FROM t) AS spread_share, (SELECT round(corr(a, b), 9) FROM r) AS rho,
(SELECT round(avg(rho), 9) FROM w WHERE rho IS NOT NULL) AS within_rho, (SELECT count(rho) FROM w) AS n_within, (SELECT round(rho, 9) FROM k WHERE pair = 'rho_1_2') AS rho_1_2, (SELECT round(rho, 9) FROM k WHERE pair = 'rho_1_3') AS rho_1_3, (SELECT round(rho, 9) FROM k WHERE pair = 'rho_2_3') AS rho_2_3""")
def judge_reliability(spark, d):
    return _rounded(V.reliability(_targets(spark, d), "cluster", "target", "rep", "score", "expert", (1, 2, 3), 0.05 + 1e-9), "n_targets", "n_clusters", "n_within")


_CASES = "c AS (SELECT l_orderkey AS item, CASE l_linenumber WHEN 1 THEN 'intact' WHEN 2 THEN 'drop' WHEN 3 THEN 'swap' WHEN 4 THEN 'triple' WHEN 5 THEN 'paraphrase' END AS kind, CASE l_linenumber WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 3 ELSE 0 END AS defects, CASE WHEN l_quantity >= 3 THEN l_discount END AS value FROM lineitem WHERE l_linenumber <= 5)"


def _cases(spark, d):
    kind = F.create_map(*[F.lit(x) for kv in {1: "intact", 2: "drop", 3: "swap", 4: "triple", 5: "paraphrase"}.items() for x in kv])
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").where(n <= 5).select(F.col("l_orderkey").alias("item"), F.element_at(kind, n.cast("int")).alias("kind"), F.when(n.isin(2, 3), 1).when(n == 4, 3).otherwise(0).alias("defects"), F.when(F.col("l_quantity") >= 3, F.col("l_discount")).alias("value"))


@query(f"""WITH {_CASES}, w AS (SELECT item, max(value) AS w FROM c WHERE kind = 'intact' AND value IS NOT NULL GROUP BY item), v AS (SELECT c.*, w, round(value - w, 12) AS d FROM c JOIN w ON w.item = c.item WHERE value IS NOT NULL),
r AS (SELECT {_RANK.format('1', 'defects')} AS a, {_RANK.format('1', 'd')} AS b FROM v WHERE kind <> 'paraphrase'),
s AS (SELECT count(DISTINCT item) AS n_items, count(*) AS n_cases, avg(CASE WHEN defects = 1 THEN CASE WHEN w > value THEN 1.0 WHEN w = value THEN 0.5 ELSE 0.0 END END) AS c1, avg(CASE WHEN kind = 'paraphrase' THEN CASE WHEN abs(d) <= 0.02 THEN 1.0 ELSE 0.0 END END) AS c3,
avg(CASE WHEN defects = 1 THEN d END) AS l1, avg(CASE WHEN defects = 3 THEN d END) AS l3, avg(CASE WHEN kind = 'paraphrase' THEN d END) AS lp FROM v), k AS (SELECT corr(a, b) AS c2 FROM r)
SELECT n_items, n_cases, round(c1, 9) AS c1, round(c2, 9) AS c2, round(c3, 9) AS c3, CAST(coalesce(c1 >= 0.8 AND c2 <= -0.5 AND c3 >= 0.8, false) AS INTEGER) AS passes, round(l1, 9) AS mean_loss_1, round(l3, 9) AS mean_loss_3, round(lp, 9) AS mean_loss_paraphrase FROM s, k""")
def measure_acceptance(spark, d):
    return _rounded(V.acceptance(_cases(spark, d), "item", "kind", "defects", "value", 0.1 + 1e-9), "n_items", "n_cases", "passes")


@query()
def perturbation_acceptance(spark, d):
    """Direct-follows F1 as the measure, on intact, once and three times perturbed and relabelled reference models."""
    g = table(spark, d, "gold_models").where("variant = 'primary'")
    c = G.compared(P.cases(g, ["sample_id", "gold_xml"], "gold_xml", "xml"), ["sample_id", "kind", "n_defects"], "gold_xml", "xml")
    return _rounded(V.acceptance(c, "sample_id", "kind", "n_defects", "df_f1"), "n_items", "n_cases", "passes")


@query("SELECT o_orderkey AS case_id, o_orderpriority AS kind, m.judge FROM orders LEFT JOIN (SELECT l_orderkey, median(l_discount) AS judge FROM lineitem WHERE l_quantity >= 40 GROUP BY 1) m ON m.l_orderkey = o_orderkey")
def case_judgements(spark, d):
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("kind"))
    scores = table(spark, d, "lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("case_id"), F.col("l_discount").cast("double").alias("score"))
    return V.case_scores(cases, scores, "case_id", "score")


@query(f"WITH {_EVAL}, c AS (SELECT item, max(median) AS ceiling FROM m WHERE item IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY item), t AS (SELECT count(*) AS n, avg(ceiling) AS v FROM c), a AS (SELECT arm, count(*) AS n, avg(median) AS v FROM m WHERE item IN (SELECT item FROM c) GROUP BY arm) SELECT 'ceiling' AS origin, n, round(v, 9) AS value, CAST(NULL AS INTEGER) AS percent FROM t UNION ALL SELECT a.arm, a.n, round(a.v, 9), CAST(round(100 * a.v / t.v) AS INTEGER) FROM a, t")
def ceiling_table(spark, d):
    """Arms on the items with a ceiling, as shares of it."""
    m = S.item_medians(_eval(spark, d), ["arm", "item"], "value")
    some = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("item"))
    ceiling = m.join(some, "item", "left_semi").groupBy("item").agg(F.max("median").alias("ceiling"))
    return _rounded(V.against_ceiling(m, "arm", "item", ceiling), "origin", "n", "percent")


@query(f"WITH {_EVAL}, p AS (SELECT arm, item, median(l_tax) AS l_tax, median(l_extendedprice) AS l_extendedprice, median(l_quantity) AS l_quantity FROM x GROUP BY ALL) SELECT arm, count(*) AS n_items, round(avg(l_tax), 6) AS mean_l_tax, round(avg(l_extendedprice), 6) AS mean_l_extendedprice, round(median(l_quantity), 6) AS median_l_quantity FROM p GROUP BY arm")
def diagnostic_table(spark, d):
    x = _eval(spark, d).select("arm", "item", *[F.col(c).cast("double").alias(c) for c in ("l_tax", "l_extendedprice", "l_quantity")])
    return _rounded(V.median_then(x, "arm", "item", ["l_tax", "l_extendedprice"], ["l_quantity"]), "arm", "n_items", digits=6)


@query(f"WITH {_EVAL}, r AS (SELECT arm, count(*) AS n_examples, min(l_tax) AS least_loss FROM x GROUP BY arm), v AS (SELECT arm, item, avg(valid) AS v FROM x GROUP BY ALL) SELECT r.arm, n_examples, least_loss, round(100 * avg(v), 6) AS validity FROM r JOIN v ON v.arm = r.arm GROUP BY ALL")
def learning_curve(spark, d):
    x = _eval(spark, d)
    runs = x.groupBy("arm").agg(F.count("*").alias("n_examples"), F.min("l_tax").alias("least_loss"))
    return _rounded(V.learning_curve(runs, x.groupBy("arm", "item").agg(F.avg("valid").alias("validity")), "arm"), "arm", "n_examples", "least_loss", digits=6)


@query(f"WITH pr AS (SELECT s_suppkey AS item, (s_acctbal + 20000) / (s_nationkey + 1) AS d FROM supplier), {_BOOT.format('avg(k.d)')} SELECT (SELECT count(*) FROM pr) AS n, (SELECT round(avg(d), 6) FROM pr) AS mean_ratio, round(min(CASE WHEN n = 250 THEN s END), 6) AS low, round(min(CASE WHEN n = 9750 THEN s END), 6) AS high FROM sr")
def mean_ratio_interval(spark, d):
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("item"), (F.col("s_acctbal") + 20000).cast("double").alias("x"), (F.col("s_nationkey") + 1).alias("y"))
    return _rounded(V.ratio_interval(x, "x", "y", "item", TIMES, 42), "n", digits=6)


@query(f"""WITH {_EVAL}, {_PAIRED}, {_RANKED}, {_BOOT.format('avg(k.d)')}, ci AS (SELECT min(CASE WHEN n = 250 THEN s END) AS low, min(CASE WHEN n = 9749 THEN s END) AS high FROM sr),
w AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS wp, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r), z AS (SELECT abs(wp - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM w), pv AS (SELECT {_P} AS p FROM z), m2 AS (SELECT count(d) AS n, avg(d) AS diff FROM pr)
SELECT n, round(diff, 6) AS diff, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, CASE WHEN low > -0.01 AND high < 0.01 THEN 'equivalent' WHEN low > 0.01 THEN 'superior' WHEN high < -0.01 THEN 'inferior' ELSE 'inconclusive' END AS verdict FROM m2, ci, pv""".replace("z AS (SELECT abs", "zz AS (SELECT abs").replace("FROM z), m2", "FROM zz), m2"))
def paired_report(spark, d):
    """n, mean difference, interval, p and verdict of a paired contrast."""
    return _rounded(V.contrast(_pairs(spark, d), "item", 0.01, TIMES, 42), "n", "verdict", digits=6)
