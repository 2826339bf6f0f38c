"""Connected components of a graph given as a table of links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.shared import kept


def _smallest(links: DataFrame) -> DataFrame:
    """Per node u its neighbours v, with the smallest of u and all its neighbours as m."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _smallest(down)
    own = stars.select("u", F.col("m").alias("v"))
    return stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(own).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has a link.

    links: two columns u, v of longs; direction, repeats and self-links do not matter; nulls are no links.
    Each round halves the depth of every tree at least; a node with very many links is only ever reduced
    by min() before its rows meet, and its rows are joined with one row, which Spark may split.
    """
    now = kept(links.where("u <> v").select("u", "v").distinct(), "links")
    state = None
    while True:
        now = kept(_small_star(_large_star(now)), "links")
        # The links of two rounds are the same set if their number and an order-free sum agree.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = seen
