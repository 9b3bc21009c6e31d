"""Connected components of a table of links, by alternating large and small stars.

Every round is two aggregations and joins over the links; no link or component reaches the
driver, and each round's links are a written table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """From links (a, b) to (node, component): the smallest node that links reach. Nodes without a link have no row.

    Repeated links, both directions and links of a node to itself are allowed; rows with a null end are ignored.
    """
    held = Staged(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:  # each round but the last makes some node's label smaller
        links = held.read()
        many = links.groupBy("u").count().where("count > 1").isEmpty()
        if many and links.join(links.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        after = Staged(_small_star(_large_star(links)), "links")
        held.drop()
        held = after
    links = held.read()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
