"""Connected components of a links table by alternating stars.

Large-star and small-star steps (Kiveris et al., 2014) point every node at the
least node it can see until nothing changes. Each step is a grouped minimum,
combined before its shuffle, and an equi-join, whose skewed keys Spark splits;
no node's neighbours are gathered in one place. The links of each round are a
written table; the driver reads two numbers of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import saved


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_least(both), "u")
        .filter("v > u AND v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """`node` and `component` (least node reachable) of every node of `links` (u, v).

    Links of a node with itself and repeated links change nothing; without
    links there are no rows.
    """
    links = saved(links.filter("u <> v").select("u", "v").distinct(), "links")
    mark = None
    while True:
        links = saved(_small_star(_large_star(links)), "links")
        now = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == mark:
            break
        mark = now
    low = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(low)
