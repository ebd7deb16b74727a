"""How far a measure can be trusted: reliability against experts, acceptance by perturbed cases, and the report tables around them."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from procmill.operators import statistics as S

#: Least concordance, greatest rho with the number of defects, least share of unharmed paraphrases, and their tolerance.
C1, C2, C3, TOLERANCE = 0.80, -0.5, 0.80, 0.20


def reliability(scores: DataFrame, cluster: str, target: str, rep: str, score: str, expert: str, reps: Sequence[int], within: float = 0.5) -> DataFrame:
    """One row on a judge that scored targets several times, beside an expert's score of each.

    rho: of the targets' median scores with the expert's, over all targets; within_rho: the mean of rho within each cluster that has
    one (n_within of them); mae: mean absolute error of the medians; spread_share: targets of two repetitions or more whose scores lie
    within `within`; rho_<a>_<b>: between two repetitions. Targets without any score are left out.
    """
    s = scores.where(F.col(score).isNotNull())
    t = s.groupBy(cluster, target).agg(F.median(score).alias("judge"), F.max(expert).alias("expert"), (F.max(score) - F.min(score)).alias("_d"), F.countDistinct(rep).alias("_n"))
    base = t.agg(F.count("*").alias("n_targets"), F.countDistinct(cluster).alias("n_clusters"), F.avg(F.abs(F.col("judge") - F.col("expert"))).alias("mae"), F.avg(F.when(F.col("_n") > 1, (F.col("_d") <= within).cast("double"))).alias("spread_share"))
    rho = S.spearman(t, "judge", "expert").select("rho")
    inner = S.spearman(t, "judge", "expert", [cluster]).where("rho is not null and not isnan(rho)").agg(F.avg("rho").alias("within_rho"), F.count("*").alias("n_within"))
    wide = s.groupBy(cluster, target).pivot(rep, list(reps)).agg(F.max(score))
    pairs = list(combinations(reps, 2))
    both = wide.select(F.explode(F.array(*[F.struct(F.lit(f"rho_{a}_{b}").alias("pair"), F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")) for a, b in pairs])).alias("p")).select("p.*")
    between = S.spearman(both, "a", "b", ["pair"]).groupBy().pivot("pair", [f"rho_{a}_{b}" for a, b in pairs]).agg(F.max("rho"))
    one = base  # every side is one row
    for x in (rho, inner, between):
        one = one.join(F.broadcast(x))
    return one


def acceptance(cases: DataFrame, item: str, kind: str, defects: str, value: str, scale: float = 1.0) -> DataFrame:
    """One row on a measure of intact and perturbed cases: c1, c2, c3 and whether it passes.

    c1: concordance of the intact case over each case of one defect; c2: rho of the number of defects with the loss, over all but
    paraphrases (null where the loss is constant); c3: share of paraphrases whose value lies within TOLERANCE times the scale of the
    intact one's. Cases without a value, and of items whose intact case has none, are left out. A missing figure fails.
    """
    whole = cases.where((F.col(kind) == "intact") & F.col(value).isNotNull()).groupBy(item).agg(F.max(value).alias("_w"))
    c = cases.where(F.col(value).isNotNull()).join(whole, item).select(item, kind, F.col(defects).alias("_n"), F.col(value).alias("_v"), "_w", F.round(F.col(value) - F.col("_w"), 12).alias("_d"))
    single, para = F.col("_n") == 1, F.col(kind) == "paraphrase"
    sums = c.agg(
        F.countDistinct(item).alias("n_items"), F.count("*").alias("n_cases"), F.avg(F.when(single & ~para, F.when(F.col("_w") > F.col("_v"), 1.0).when(F.col("_w") == F.col("_v"), 0.5).otherwise(0.0))).alias("c1"),
        F.avg(F.when(para, (F.abs("_d") <= TOLERANCE * scale).cast("double"))).alias("c3"), F.avg(F.when(single & ~para, F.col("_d"))).alias("mean_loss_1"), F.avg(F.when(F.col("_n") == 3, F.col("_d"))).alias("mean_loss_3"), F.avg(F.when(para, F.col("_d"))).alias("mean_loss_paraphrase"),
    )
    rho = S.spearman(c.where(~para), "_n", "_d").select(F.col("rho").alias("c2"))
    out = sums.join(F.broadcast(rho))  # one row each
    passes = (F.col("c1") >= C1) & (F.col("c2") <= C2) & (F.col("c3") >= C3)
    return out.select("n_items", "n_cases", "c1", "c2", "c3", F.coalesce(passes, F.lit(False)).cast("int").alias("passes"), "mean_loss_1", "mean_loss_3", "mean_loss_paraphrase")


def case_scores(cases: DataFrame, scores: DataFrame, case: str, score: str) -> DataFrame:
    """cases with the median of their scores, null for those without any."""
    return cases.join(scores.where(F.col(score).isNotNull()).groupBy(case).agg(F.median(score).alias("judge")), case, "left")


def against_ceiling(medians: DataFrame, arm: str, item: str, ceiling: DataFrame, value: str = "median") -> DataFrame:
    """(origin, n, value, percent): every arm's mean over the items that have a ceiling, as a share of the mean ceiling, which is a row
    of its own. ceiling: (item, ceiling). Percent is null for the ceiling."""
    top = ceiling.agg(F.count("*").alias("n"), F.avg("ceiling").alias("value"))
    arms = medians.join(ceiling.select(item), item, "left_semi").groupBy(F.col(arm).alias("origin")).agg(F.count("*").alias("n"), F.avg(value).alias("value"))
    arms = arms.join(F.broadcast(top.select(F.col("value").alias("_top")))).select("origin", "n", "value", F.round(100 * F.try_divide("value", "_top")).cast("int").alias("percent"))
    return top.select(F.lit("ceiling").alias("origin"), "n", "value", F.lit(None).cast("int").alias("percent")).union(arms)


def median_then(df: DataFrame, arm: str, item: str, means: Sequence[str], medians: Sequence[str] = ()) -> DataFrame:
    """(arm, n_items, mean_<c>, median_<c>): per arm the mean, or the median, of the items' medians of each column."""
    every = [*means, *medians]
    per = df.groupBy(arm, item).agg(*[F.median(c).alias(c) for c in every])
    return per.groupBy(arm).agg(F.count("*").alias("n_items"), *[F.avg(c).alias(f"mean_{c}") for c in means], *[F.median(c).alias(f"median_{c}") for c in medians])


def learning_curve(runs: DataFrame, validity: DataFrame, arm: str, by: str = "n_examples") -> DataFrame:
    """Training runs (arm, n_examples, least_loss) with the mean validity of their arm's items, in percent, in order of their size."""
    v = validity.groupBy(arm).agg((100 * F.avg("validity")).alias("validity"))
    return runs.join(v, arm).orderBy(by, arm)


def ratio_interval(df: DataFrame, x: str, y: str, item: str, times: int, seed: int) -> DataFrame:
    """(n, mean_ratio, low, high): the mean of the items' ratios x / y and its bootstrap interval."""
    r = df.where(F.col(y) != 0).select(item, (F.col(x) / F.col(y)).cast("double").alias("_r"))
    ci = S.interval(S.bootstrap(r, "_r", item, times, seed), times)
    return r.agg(F.count("*").alias("n"), F.avg("_r").alias("mean_ratio")).join(F.broadcast(ci))  # one row each


def contrast(pairs: DataFrame, item: str, margin: float, times: int, seed: int) -> DataFrame:
    """(n, diff, low, high, p, verdict) of paired differences d; with fewer than two pairs only n."""
    ci = S.interval(S.bootstrap(pairs, "d", item, times, seed), times, upper_less_one=True)
    m = pairs.agg(F.count("d").alias("n"), F.avg("d").alias("diff"))
    p = S.wilcoxon(pairs).agg(F.coalesce(F.max("p"), F.lit(1.0)).alias("p"))
    one = m.join(F.broadcast(ci)).join(F.broadcast(p))  # one row each
    few = F.col("n") < 2
    return one.select("n", *[F.when(~few, F.col(c)).alias(c) for c in ("diff", "low", "high", "p")], F.when(~few, S.verdict(F.col("low"), F.col("high"), margin)).alias("verdict"))
