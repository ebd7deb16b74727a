"""Connected components of a graph of links, as rounds of joins; nothing but one count per round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from procmill.session import materialize


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(cls, root): the least class of its component for every class with a link. links: (a, b), in any order, repeated or not.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): links of a node move to its least neighbour, so a chain of
    n links needs about log2(n) rounds, and no round holds more links than the input. Every round is written to the shared folder.
    A node with very many links is skewed only in aggregates that combine before the shuffle (min) and in joins that AQE splits.
    """
    e = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        # large star: neighbours larger than the node are linked to the least of the node and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours not larger than the node, and the node, are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        said = Observation()  # count and sum of the links, taken while they are written
        e = materialize(small.observe(said, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), name)
        if before == said.get:
            break
        before = said.get
    return e.select(F.col("u").alias("cls"), F.col("v").alias("root")).union(e.select(F.col("v").alias("cls"), F.col("v").alias("root"))).distinct()
