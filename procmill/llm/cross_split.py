"""The same or nearly the same records in evaluation and training splits (problem 5).

Exact prefix-filter bipartite join on rare shingles: prefixes of evaluation sets are indexed, training sets probe them, and the
sets verify. Copies count once as a class, and are expanded in the result only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from procmill.llm.prefix import candidates, prefixes, rarity
from procmill.llm.sets import Sets, jaccard_pairs, shingle_sets
from procmill.session import materialize

TRAIN, EVAL = ("sft",), ("validation", "holdout")


def split_of(c: str = "split") -> Column:
    """The split's name without blanks around it, in lower case; null stays null."""
    return F.lower(F.regexp_replace(F.col(c), r"^[\s ]+|[\s ]+$", ""))


def split_sets(samples: DataFrame, k: int = 3, least_words: int = 20) -> Sets:
    """Sets of training and evaluation samples; rows without a known split are left out."""
    s = split_of()
    rows = samples.where(s.isin(*TRAIN, *EVAL) & F.col("id").isNotNull())
    return shingle_sets(rows, F.col("raw_text"), {"id": F.col("id"), "split": s, "source": F.col("source"), "side": s.isin(*EVAL)}, k, least_words, name="splits")


def overlapping_classes(sets: Sets, least: float = 0.8) -> DataFrame:
    """(a, b, similarity): classes a with evaluation members and b with training members, similar by at least `least`."""
    first = materialize(prefixes(sets.rows, least, rarity(sets.rows), ("side",)).distinct(), "prefixes")
    pairs = materialize(candidates(first.where("side"), first.where("not side"), least), "pairs")
    return jaccard_pairs(pairs, sets, least)


def cross_split_pairs(samples: DataFrame, least: float = 0.8, k: int = 3, least_words: int = 20) -> DataFrame:
    """(eval_id, train_id, eval_split, eval_source, train_source, similarity), one row for each pair of records.

    Texts with fewer than least_words words, null and blank texts are in no pair; a record is never paired with its own id. Rows
    repeated with the same id, split and source count once. Empty tables give no rows.
    """
    sets = split_sets(samples, k, least_words)
    found = materialize(overlapping_classes(sets, least), "overlaps")
    m = sets.members
    e = m.where("side").select(F.col("cls").alias("a"), F.col("id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    t = m.where("not side").select(F.col("cls").alias("b"), F.col("id").alias("train_id"), F.col("source").alias("train_source"))
    return found.join(e, "a").join(t, "b").where("eval_id <> train_id").select("eval_id", "train_id", "eval_split", "eval_source", "train_source", "similarity")


def found(samples: DataFrame) -> DataFrame:
    return cross_split_pairs(samples).select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def report(samples: DataFrame) -> DataFrame:
    """Per evaluation split and source: overlapping evaluation records, training records they meet, and exact ones among them.

    Counted from classes: of each class's ids the least and the greatest say whether there is one besides a record's own, so pairs of
    records are never made.
    """
    sets = split_sets(samples)
    found = materialize(overlapping_classes(sets), "overlaps")
    m = sets.members
    e = m.where("side").select(F.col("cls").alias("a"), "id", F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    t = m.where("not side").select(F.col("cls").alias("b"), "id")
    ends = lambda p="": [F.min(f"{p}lo").alias(f"{p}lo"), F.max(f"{p}hi").alias(f"{p}hi")]
    other = lambda p="": (F.col(f"{p}lo") != F.col(f"{p}hi")) | (F.col("id") != F.col(f"{p}lo"))
    same = F.col("similarity") == 1
    per_a = found.join(t.groupBy("b").agg(F.min("id").alias("lo"), F.max("id").alias("hi")), "b").select("a", "lo", "hi", F.when(same, F.col("lo")).alias("xlo"), F.when(same, F.col("hi")).alias("xhi")).groupBy("a").agg(*ends(), *ends("x"))
    evals = e.join(per_a, "a").groupBy("eval_split", "eval_source").agg(F.countDistinct(F.when(other(), F.col("id"))).alias("n_eval"), F.countDistinct(F.when(other("x"), F.col("id"))).alias("n_exact"))
    per_b = found.join(e.groupBy("a", "eval_split", "eval_source").agg(F.min("id").alias("lo"), F.max("id").alias("hi")), "a").groupBy("b", "eval_split", "eval_source").agg(*ends())
    trains = per_b.join(t, "b").where(other()).groupBy("eval_split", "eval_source").agg(F.countDistinct("id").alias("n_train"))
    x, y = evals.where("n_eval > 0").alias("x"), trains.alias("y")
    return x.join(y, F.expr("x.eval_split <=> y.eval_split and x.eval_source <=> y.eval_source")).select("x.eval_split", "x.eval_source", "n_eval", "n_train", "n_exact")
