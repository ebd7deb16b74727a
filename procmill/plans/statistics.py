"""Item medians, paired contrasts, rank tests and resampling on lineitem rows read as an experiment: arm = return flag, item =
supplier, repetition = line number, score = discount (none for small quantities), valid = line status F. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmill.operators import statistics as S
from procmill.session import table

#: Resamples of every bootstrap.
TIMES = 10_000

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _eval(spark, d):
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_returnflag").alias("arm"), F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("rep"), F.when(F.col("l_quantity") >= 3, F.col("l_discount")).alias("value"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("valid"), "l_tax", "l_extendedprice", "l_quantity")


_EVAL = "x AS (SELECT l_returnflag AS arm, l_suppkey AS item, l_linenumber AS rep, CASE WHEN l_quantity >= 3 THEN l_discount END AS value, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS valid, l_tax, l_extendedprice, l_quantity FROM lineitem), m AS (SELECT arm, item, median(coalesce(value, 0.0)) AS median FROM x GROUP BY ALL)"


@query(f"WITH {_EVAL} SELECT arm, item, round(median, 6) AS median FROM m")
def per_item_median(spark, d):
    return S.item_medians(_eval(spark, d), ["arm", "item"], "value").withColumn("median", F.round("median", 6))


@query(f"WITH {_EVAL} SELECT arm, count(*) AS n_items, round(avg(median), 6) AS mean FROM m GROUP BY arm")
def mean_of_medians(spark, d):
    return S.arm_means(S.item_medians(_eval(spark, d), ["arm", "item"], "value"), "arm").withColumn("mean", F.round("mean", 6))


@query(f"WITH {_EVAL}, s AS (SELECT arm, item, count(*) AS n, max(coalesce(value, 0)) - min(coalesce(value, 0)) AS spread FROM x GROUP BY ALL HAVING count(*) > 1) SELECT arm, count(*) AS n_items, round(max(spread), 6) AS max_spread, CAST(sum(CASE WHEN spread > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_divergent FROM s GROUP BY arm")
def spread_per_item(spark, d):
    return S.item_spread(_eval(spark, d), "arm", "item", "value").withColumn("max_spread", F.round("max_spread", 6))


@query(f"WITH {_EVAL} SELECT arm, count(*) AS n, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unscored, CAST(sum(valid) AS BIGINT) AS n_valid FROM x GROUP BY arm")
def arm_summary(spark, d):
    return _eval(spark, d).groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_unscored"), F.sum("valid").alias("n_valid"))


@query(f"WITH {_EVAL} SELECT arm, item, round(avg(valid), 6) AS validity FROM x GROUP BY ALL")
def item_validity(spark, d):
    return _eval(spark, d).groupBy("arm", "item").agg(F.round(F.avg("valid"), 6).alias("validity"))


@query(f"WITH {_EVAL}, a AS (SELECT arm, item, rep, median(value) AS v FROM x WHERE value IS NOT NULL GROUP BY ALL), b AS (SELECT arm, item, avg(v) AS v FROM a GROUP BY ALL) SELECT arm, round(avg(v), 6) AS score FROM b GROUP BY arm")
def three_level_score(spark, d):
    a = _eval(spark, d).where("value is not null").groupBy("arm", "item", "rep").agg(F.median("value").alias("v"))
    return a.groupBy("arm", "item").agg(F.avg("v").alias("v")).groupBy("arm").agg(F.round(F.avg("v"), 6).alias("score"))


@query(f"""WITH {_EVAL}, s AS (SELECT arm, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM x GROUP BY arm)
SELECT arm, v[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1] AS q50, v[least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) + 1] AS q90, v[least(n - 1, CAST(floor(0.99 * n) AS BIGINT)) + 1] AS q99 FROM s""")
def nearest_rank_quantiles(spark, d):
    return S.quantiles(_eval(spark, d), ["arm"], "l_extendedprice", [0.5, 0.9, 0.99])


_PAIRED = "pr AS (SELECT a.item, a.median AS a, b.median AS b, a.median - b.median AS d FROM m a JOIN m b ON a.item = b.item WHERE a.arm = 'A' AND b.arm = 'R')"


def _pairs(spark, d):
    return S.paired(S.item_medians(_eval(spark, d), ["arm", "item"], "value"), "arm", "item", "A", "R")


@query(f"WITH {_EVAL}, {_PAIRED} SELECT item, round(a, 6) AS a, round(b, 6) AS b, round(d, 6) AS d FROM pr")
def paired_contrast(spark, d):
    return _pairs(spark, d).select("item", *[F.round(c, 6).alias(c) for c in "abd"])


@query(f"WITH {_EVAL}, {_PAIRED}, s AS (SELECT CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS losses FROM pr) SELECT wins, losses, round((wins - losses) / (wins + losses), 9) AS effect FROM s")
def rank_biserial(spark, d):
    return S.rank_biserial(_pairs(spark, d)).withColumn("effect", F.round("effect", 9))


_RANKED = "z AS (SELECT round(d, 9) AS d, abs(round(d, 9)) AS ab FROM pr WHERE round(d, 9) <> 0), r AS (SELECT d, rank() OVER (ORDER BY ab) + (count(*) OVER (PARTITION BY ab) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY ab) AS t FROM z)"


@query(f"WITH {_EVAL}, {_PAIRED}, {_RANKED} SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, CAST(sum(t * t - 1) AS BIGINT) AS ties FROM r")
def signed_rank_sums(spark, d):
    return S.signed_rank(_pairs(spark, d))


#: The two-sided p of a normal z by the series of the error function; 0 from 5.5 on.
_P = "CASE WHEN z >= 5.5 THEN 0.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda j: (CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * j + 1) * ln(greatest(z / sqrt(2), 1e-300)) - lgamma(j + 1)) / (2 * j + 1)))) END"


@query(f"WITH {_EVAL}, {_PAIRED}, {_RANKED}, w AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, CAST(sum(t * t - 1) AS BIGINT) AS ties FROM r), zz AS (SELECT *, abs(w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM w) SELECT n, w_plus, w_minus, ties, round({_P}, 9) AS p FROM zz")
def wilcoxon_p(spark, d):
    return S.wilcoxon(_pairs(spark, d)).withColumn("p", F.round("p", 9))



@query("""WITH p AS (SELECT p_brand AS k, round(avg(p_size) / 2000.0, 9) AS p FROM part GROUP BY p_brand), r AS (SELECT k, p, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, k) + 1) * p) AS s FROM p)
SELECT k, p, round(max(s) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM r""")
def holm_adjust(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("k")).agg(F.round(F.avg("p_size") / 2000.0, 9).alias("p"))
    return S.holm(p, "p", ["k"]).withColumn("p_holm", F.round("p_holm", 9))


@query(f"WITH {_EVAL}, r AS (SELECT arm, rank() OVER (PARTITION BY arm ORDER BY l_quantity) + (count(*) OVER (PARTITION BY arm, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY arm ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY arm, l_extendedprice) - 1) / 2.0 AS b FROM x) SELECT arm, count(*) AS n, round(corr(a, b), 9) AS rho FROM r GROUP BY arm")
def spearman_rho(spark, d):
    return S.spearman(_eval(spark, d), "l_quantity", "l_extendedprice", ["arm"]).withColumn("rho", F.round("rho", 9))


@query(f"WITH {_EVAL} SELECT arm, count(*) AS n, round(avg(CASE WHEN value > l_tax THEN 1.0 WHEN value = l_tax THEN 0.5 ELSE 0.0 END), 9) AS concordance FROM x GROUP BY arm")
def concordance(spark, d):
    return S.concordance(_eval(spark, d), "value", "l_tax", ["arm"]).withColumn("concordance", F.round("concordance", 9))


_BOOT = "k AS (SELECT row_number() OVER (ORDER BY item) - 1 AS i, d FROM pr), c AS (SELECT count(*) AS n FROM k), pk AS (SELECT b.b, CAST('0x' || substr(md5('42-' || b.b || '-' || k.i), 1, 8) AS BIGINT) % c.n AS i FROM k, c, (SELECT unnest(range(10000)) AS b) b), st AS (SELECT pk.b, {} AS s FROM pk JOIN k ON k.i = pk.i GROUP BY pk.b), sr AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS n FROM st)"


@query(f"WITH {_EVAL}, {_PAIRED}, {_BOOT.format('avg(k.d)')} SELECT round(min(CASE WHEN n = 250 THEN s END), 9) AS low, round(min(CASE WHEN n = 9749 THEN s END), 9) AS high FROM sr")
def bootstrap_mean_ci(spark, d):
    return S.interval(S.bootstrap(_pairs(spark, d), "d", "item", TIMES, 42), TIMES, upper_less_one=True).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"WITH {_EVAL}, {_PAIRED}, {_BOOT.format('median(k.d)')} SELECT round(min(CASE WHEN n = 250 THEN s END), 9) AS low, round(min(CASE WHEN n = 9750 THEN s END), 9) AS high FROM sr")
def bootstrap_median_ci(spark, d):
    return S.interval(S.bootstrap(_pairs(spark, d), "d", "item", TIMES, 42, "median"), TIMES).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"WITH {_EVAL}, {_PAIRED}, {_BOOT.format('avg(k.d)')}, ci AS (SELECT min(CASE WHEN n = 250 THEN s END) AS low, min(CASE WHEN n = 9749 THEN s END) AS high FROM sr) SELECT CASE WHEN low > -0.01 AND high < 0.01 THEN 'equivalent' WHEN low > 0.01 THEN 'superior' WHEN high < -0.01 THEN 'inferior' ELSE 'inconclusive' END AS verdict FROM ci")
def equivalence_verdict(spark, d):
    return S.interval(S.bootstrap(_pairs(spark, d), "d", "item", TIMES, 42), TIMES, upper_less_one=True).select(S.verdict(F.col("low"), F.col("high"), 0.01).alias("verdict"))


@query()
def cluster_bootstrap(spark, d):
    return _cluster_rhos(spark, d).withColumn("rho", F.round("rho", 9))


@query()
def cluster_bootstrap_ci(spark, d):
    """The interval of rho over resampled clusters; positions by the number of resamples kept."""
    ci = S.interval(_cluster_rhos(spark, d).select(F.col("rho").alias("stat")), upper_less_one=True)
    return ci.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def _cluster_rhos(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("c"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return S.cluster_bootstrap_rho(e, "c", "x", "y", TIMES, 7)


@query("WITH r AS (SELECT l_returnflag AS arm, l_extendedprice / l_quantity AS r FROM lineitem WHERE l_quantity <> 0) SELECT arm, count(*) AS n, round(avg(r), 6) AS mean_ratio, round(median(r), 6) AS median_ratio, round(1 - 1 / avg(r), 9) AS reduction FROM r GROUP BY arm")
def ratio_mean(spark, d):
    r = S.mean_ratio(_eval(spark, d), "l_extendedprice", "l_quantity", ["arm"])
    return r.select("arm", "n", F.round("mean_ratio", 6).alias("mean_ratio"), F.round("median_ratio", 6).alias("median_ratio"), F.round("reduction", 9).alias("reduction"))


@query(f"WITH {_EVAL}, {_PAIRED} SELECT t.t AS threshold, count(*) AS n, CAST(sum(CASE WHEN abs(d) >= t.t THEN 1 ELSE 0 END) AS BIGINT) AS n_over FROM pr, (SELECT unnest([0.0, 0.005, 0.01, 0.02]) AS t) t GROUP BY ALL")
def threshold_curve(spark, d):
    t = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.005, 0.01, 0.02)]))
    return _pairs(spark, d).select("d", t.alias("threshold")).groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(F.abs("d") >= F.col("threshold")).alias("n_over"))


@query(f"WITH {_EVAL}, {_PAIRED}, ok AS (SELECT item FROM x WHERE arm = 'A' GROUP BY item HAVING avg(valid) >= 0.5) SELECT round(round(avg(a), 4) - round(avg(b), 4), 4) AS diff_all, (SELECT round(round(avg(a), 4) - round(avg(b), 4), 4) FROM pr WHERE item IN (SELECT item FROM ok)) AS diff_valid FROM pr")
def conditional_contrast(spark, d):
    p = _pairs(spark, d)
    ok = _eval(spark, d).where("arm = 'A'").groupBy("item").agg(F.avg("valid").alias("v")).where("v >= 0.5").select("item", F.lit(1).alias("ok"))
    p = p.join(ok, "item", "left")
    diff = lambda c: F.round(F.round(F.avg(F.when(c, F.col("a"))), 4) - F.round(F.avg(F.when(c, F.col("b"))), 4), 4)
    return p.agg(diff(F.lit(True)).alias("diff_all"), diff(F.col("ok") == 1).alias("diff_valid"))


@query(f"WITH {_EVAL} SELECT item, round(max(CASE WHEN arm = 'A' THEN median END), 6) AS a, round(max(CASE WHEN arm = 'N' THEN median END), 6) AS n, round(max(CASE WHEN arm = 'R' THEN median END), 6) AS r FROM m GROUP BY item")
def pivot_arms(spark, d):
    m = S.item_medians(_eval(spark, d), ["arm", "item"], "value")
    return m.groupBy("item").pivot("arm", ["A", "N", "R"]).agg(F.round(F.max("median"), 6)).select("item", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("SELECT l_orderkey AS target, string_agg(l_linenumber || ':' || CAST(l_quantity AS BIGINT), ',' ORDER BY l_linenumber, l_quantity) AS reps, count(*) AS n FROM lineitem GROUP BY 1")
def fold_repetitions(spark, d):
    """Scores per repetition folded into one row per target."""
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("target")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("bigint").alias("q")))).alias("r"))
    return r.select("target", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["q"].cast("string"))), ",").alias("reps"), F.size("r").cast("bigint").alias("n"))


@query(f"WITH {_EVAL}, {_PAIRED}, {_BOOT.format('avg(k.d)')}, ci AS (SELECT min(CASE WHEN n = 250 THEN s END) AS low, min(CASE WHEN n = 9749 THEN s END) AS high FROM sr), mm AS (SELECT avg(d) AS diff, count(*) AS n FROM pr) SELECT 'A - R' AS contrast, n, round(diff, 9) AS diff, round(high - diff, 9) AS up, round(diff - low, 9) AS down FROM mm, ci")
def contrast_rows(spark, d):
    """A contrast as a figure needs it: difference and the lengths of its error bars."""
    p = _pairs(spark, d)
    ci = S.interval(S.bootstrap(p, "d", "item", TIMES, 42), TIMES, upper_less_one=True)
    m = p.agg(F.avg("d").alias("diff"), F.count("*").alias("n"))
    return m.join(F.broadcast(ci)).select(F.lit("A - R").alias("contrast"), "n", F.round("diff", 9).alias("diff"), F.round(F.col("high") - F.col("diff"), 9).alias("up"), F.round(F.col("diff") - F.col("low"), 9).alias("down"))  # one row each
