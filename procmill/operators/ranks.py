"""Exact ranks of any number of rows, without sorting a group in one task.

Values are counted first, so a value that many rows share is one row; the counts are range-partitioned, summed within each part and
shifted by the sums of the parts before. A group is spread over as many parts as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from procmill.session import materialize


def same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns], F.lit(True))


def exact_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, upto, total): per key and distinct value its rows, the rows with at most that value, and all rows of the key.

    Null values are left out; null keys are a key like others; NaN is the largest value.
    """
    k = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*k, value).agg(F.count("*").alias("n"))
    local = materialize(counted.repartitionByRange(*k, value).withColumn("part", F.spark_partition_id()), "ranks")
    run = local.withColumn("upto", F.sum("n").over(W.partitionBy("part", *k).orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    sums = local.groupBy(*k, "part").agg(F.sum("n").alias("s"))  # a row per part and key: parts + keys at most, as parts are ranges
    w = W.partitionBy(*k)
    offsets = sums.select(*k, "part", (F.sum("s").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("s")).alias("before"), F.sum("s").over(w).alias("total"))
    return run.join(offsets, same(run, offsets, [*k, "part"])).select(*[run[c] for c in k], run[value], "n", (F.col("upto") + F.col("before")).alias("upto"), "total")


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the rank of `value` within the keys, ties sharing the mean of their ranks; rows with a null value are left out."""
    r = exact_ranks(df, keys, value).withColumn("_rank", F.col("upto") - (F.col("n") - 1) / 2.0)
    return df.join(r, same(df, r, [*keys, value])).select(*[df[c] for c in df.columns], F.col("_rank").alias(name))
