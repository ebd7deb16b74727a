"""Work queues, history tables, and multiset algebra on DataFrames. Everything here is one Catalyst plan; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


# ---- predicates ----

def where_set(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the parameters that are set; None filters nothing, a list or tuple filters by membership."""
    for c, v in wanted.items():
        if v is not None:
            df = df.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def not_blank(c: str) -> Column:
    """True for text with anything but spaces in it; null is not."""
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def flag(condition: Column) -> Column:
    """1 or 0; null counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def none_shared(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether no key is in both: the guard against evaluation keys in training data."""
    return a.select(key).join(b.select(key), key, "left_semi").isEmpty()


def require_none_shared(a: DataFrame, b: DataFrame, key: str) -> None:
    if not none_shared(a, b, key):
        raise ValueError(f"the same {key} is on both sides")


# ---- work queues ----

def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of work whose keys no row of done has (anti-join). Null keys are never done."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def pending_runs(work: DataFrame, runs: DataFrame, keys: Sequence[str], version: str, retry_failed: bool = False, version_col: str = "version", status_col: str = "status", success: str = "succeeded") -> DataFrame:
    """Work without a run of this version; with retry_failed, without a succeeded run of it. A new version makes all work pending."""
    done = runs.where(F.col(version_col) == version)
    return pending(work, done.where(F.col(status_col) == success) if retry_failed else done, keys)


def pending_or_retry(work: DataFrame, history: DataFrame, key: str, retry: Column, done: Column, history_key: str) -> DataFrame:
    """Work with a history row to retry, or with none that is done. Both conditions come from one aggregate per key and one join."""
    state = history.groupBy(F.col(history_key).alias("_k")).agg(F.max(flag(retry)).alias("_retry"), F.max(flag(done)).alias("_done"))
    return work.join(state, work[key] == state["_k"], "left").where((F.coalesce("_retry", F.lit(0)) == 1) | (F.coalesce("_done", F.lit(0)) == 0)).drop("_k", "_retry", "_done")


def repetitions_pending(items: DataFrame, done: DataFrame, keys: Sequence[str], k: int, rep: str = "rep") -> DataFrame:
    """Every item with every repetition 0..k-1 that is not done. The repetitions are a column of k values, not a join."""
    return pending(items.withColumn(rep, F.explode(F.sequence(F.lit(0), F.lit(k - 1)))), done, [*keys, rep])


# ---- history ----

def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; WindowGroupLimit keeps one row per key before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def best(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """The row with the highest score per key, nulls last, ties by `tie` ascending."""
    return latest(df, keys, [F.col(score).desc_nulls_last(), *[F.col(c) for c in tie]])


def prune(history: DataFrame, keys: Sequence[str], id_col: str = "id", status: str = "status", failed: str = "failed") -> tuple[DataFrame, DataFrame]:
    """(kept, removed): in each group of more than one row that has one not failed, only the latest such row stays; other groups stay whole.

    Keys compare null-safe. Rows that repeat the kept id stay.
    """
    w = W.partitionBy(*keys)
    marked = history.withColumn("_n", F.count("*").over(w)).withColumn("_keep", F.max(F.when(F.coalesce(F.col(status) != failed, F.lit(True)), F.col(id_col))).over(w))
    gone = (F.col("_n") > 1) & F.col("_keep").isNotNull() & (F.col(id_col) != F.col("_keep"))
    return marked.where(~F.coalesce(gone, F.lit(False))).drop("_n", "_keep"), marked.where(gone).drop("_n", "_keep")


# ---- keyed tables ----

def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and new rows with keys that are not there yet; of new rows with equal keys one stands."""
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def insert_or_replace(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """New rows win over old ones with equal keys; among new ones the greatest `order` does."""
    new = latest(new, keys, [F.col(order).desc_nulls_last()]) if order else new.dropDuplicates(list(keys))
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Insert, or on equal keys update; columns in `keep` stay as they were in rows that exist."""
    new = new.dropDuplicates(list(keys))
    if keep:
        was = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep], F.lit(True).alias("_was"))
        new = new.join(was, list(keys), "left")
        for c in keep:
            new = new.withColumn(c, F.when(F.col("_was"), F.col(f"_{c}")).otherwise(F.col(c)) if c in new.columns else F.col(f"_{c}"))
        new = new.select(*[c for c in old.columns if c in new.columns])
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def update(old: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], stamp: str | None = None, now: Column | None = None) -> DataFrame:
    """Old rows with `columns` taken from changes where a row with equal keys has a value there. stamp: a column that gets `now` (the
    current time, if not said) in rows that have changes."""
    changes = changes.dropDuplicates(list(keys)).select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = old.join(changes, list(keys), "left")
    stamped = {stamp: F.when(F.col("_hit"), now if now is not None else F.current_timestamp()).otherwise(F.col(stamp))} if stamp else {}
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else stamped[c].alias(c) if c in stamped else F.col(c) for c in old.columns])


def prefixed(c: str, prefix: str) -> Column:
    """Whether text begins with a prefix, whatever the case of ASCII letters; null is null."""
    return F.lower(F.substring(c, 1, len(prefix))) == F.lit(prefix.lower())


def changed(old: DataFrame, new: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, old value, new value) where a recomputed column differs, null-safe."""
    n = new.select(*keys, F.col(column).alias("new_value"))
    return old.select(*keys, F.col(column).alias("old_value")).join(n, list(keys)).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def replace_slice(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Old rows outside the slices (values of `columns`) that new has, and new."""
    return old.join(new.select(*columns).distinct(), list(columns), "left_anti").unionByName(new, allowMissingColumns=True)


# ---- multisets: (key columns, n) ----

def bag(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def bag_sum(*bags: DataFrame) -> DataFrame:
    """Counts added up."""
    keys = [c for c in bags[0].columns if c != "n"]
    return reduce(DataFrame.unionByName, bags).groupBy(*keys).agg(F.sum("n").alias("n"))


def _both(a: DataFrame, b: DataFrame) -> tuple[DataFrame, list[str]]:
    keys = [c for c in a.columns if c != "n"]
    return a.withColumnRenamed("n", "_a").join(b.withColumnRenamed("n", "_b"), keys, "full_outer").fillna(0, ["_a", "_b"]), keys


def bag_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    both, keys = _both(a, b)
    return both.select(*keys, F.least("_a", "_b").alias("n")).where("n > 0")


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    both, keys = _both(a, b)
    return both.select(*keys, (F.col("_a") - F.col("_b")).alias("n")).where("n > 0")


def bag_scores(reference: DataFrame, candidate: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, n_ref, n_cand, n_both, precision, recall, f1) per group in either; shares of an empty side are 0 unless both are empty."""
    both, _ = _both(reference, candidate)
    s = both.groupBy(*group).agg(F.sum("_a").alias("n_ref"), F.sum("_b").alias("n_cand"), F.sum(F.least("_a", "_b")).alias("n_both"))
    p = F.when(F.col("n_cand") > 0, F.col("n_both") / F.col("n_cand")).when(F.col("n_ref") == 0, 1.0).otherwise(0.0)
    r = F.when(F.col("n_ref") > 0, F.col("n_both") / F.col("n_ref")).when(F.col("n_cand") == 0, 1.0).otherwise(0.0)
    s = s.select("*", p.alias("precision"), r.alias("recall"))
    return s.select("*", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0).alias("f1"))


# ---- windows ----

def fill_both_ways(c: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The last known value so far, else the first known later."""
    w = W.partitionBy(*keys).orderBy(*order)
    return F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first(c, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))


def islands(df: DataFrame, c: str, keys: Sequence[str], order: Sequence[str], name: str = "island") -> DataFrame:
    """Numbers the runs of equal consecutive values (null equals null) from 1 within the keys."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = flag(~F.col(c).eqNullSafe(F.lag(c).over(w)) | (F.row_number().over(w) == 1))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def first_wins(df: DataFrame, c: str, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with a name of its own for every row of the keys: the first row of a name keeps it, the others get _2, _3, ... without the
    numbers under which the name is there already."""
    k = list(keys)
    base, number = F.regexp_extract(c, r"(?s)^(.*)_(\d{1,9})$", 1), F.regexp_extract(c, r"(?s)^(.*)_(\d{1,9})$", 2)
    taken = df.where(number != "").select(*k, base.alias(c), number.cast("int").alias("_t")).groupBy(*k, c).agg(F.collect_set("_t").alias("_taken"))
    n = F.row_number().over(W.partitionBy(*k, c).orderBy(*order))
    out = df.withColumn("_n", n).join(taken, [*k, c], "left")
    held = F.coalesce("_taken", F.array().cast("array<int>"))
    free = F.get(F.array_except(F.sequence(F.lit(2), F.col("_n") + F.size(held) + 1), held), F.col("_n") - 2)
    return out.withColumn(name, F.when(F.col("_n") == 1, F.col(c)).otherwise(F.concat_ws("_", c, free.cast("string")))).select(*df.columns, name)


def matched_one_to_one(scores: DataFrame, a: str, b: str, score: str, n_a: int, n_b: int) -> DataFrame:
    """(a, b, score): each a with its best b (ties by name), which must be the best of no other and leave nobody out; else ValueError.

    For lists of files and names, which a report lists: the check counts, it collects nothing.
    """
    best_of = best(scores, [a], score, [b]).select(a, b, score)
    n = best_of.agg(F.count("*").alias("n"), F.countDistinct(b).alias("m")).first()
    if (n["n"], n["m"]) != (n_a, n_b):
        raise ValueError(f"no bijection: {n['n']} of {n_a} matched to {n['m']} of {n_b}")
    return best_of


def group_split(df: DataFrame, group: str, fraction: float) -> DataFrame:
    """(group, n, part): groups in order of their sha1 go to 'validation' until it holds int(total * fraction) rows, so no group is on
    both sides, and the split of the groups there are is the same on every run."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("_h", F.sha1(F.col(group).cast("string")))
    total = df.agg(F.floor(F.count("*") * F.lit(fraction)).alias("_target"))
    # running totals in two steps: within buckets of leading hash digits, and over the buckets' sums, so no task sorts all groups
    sizes = sizes.withColumn("_b", F.substring("_h", 1, 3))
    w = W.partitionBy("_b").orderBy("_h", group)
    sums = sizes.groupBy("_b").agg(F.sum("n").alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(W.orderBy("_b")) - F.col("_s")).alias("_before"))  # at most 4,096 rows
    out = sizes.withColumn("_run", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).join(F.broadcast(before), "_b").join(F.broadcast(total))
    return out.select(group, "n", F.when(F.col("_before") + F.col("_run") - F.col("n") < F.col("_target"), "validation").otherwise("training").alias("part"))


def nested_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Rows whose key's hash falls in the first `fraction` of all hashes; smaller fractions are subsets of larger ones."""
    return df.where(F.conv(F.substring(F.sha1(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") < F.lit(int(fraction * (1 << 32))))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows per stratum without replacement, by the hash of key and seed."""
    return latest_n(df, [stratum], [F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")), 256), F.col(key)], n)


def latest_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
