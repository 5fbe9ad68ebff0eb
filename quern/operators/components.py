"""Connected components by alternating large-star and small-star joins.

Large-star links every larger neighbour of a node to the least node around it,
small-star does so for the smaller ones; a few alternations leave one star per
component. Each step is an aggregation with a map-side minimum and an
equi-join, so a hub is split by adaptive skew handling and never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.checkpoints import cut, release


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(e: DataFrame) -> bool:
    """Whether each node points at one other and none of those points on."""
    if not e.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return e.join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links(u, v); component is the least node of it.

    Null ends are dropped, a self-link makes a component of one; links in any number and order.
    """
    links = links.filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    edges = links.filter("u <> v").select("u", "v")
    before = None
    while True:
        edges = cut(_small_star(_large_star(edges)))
        if before is not None:
            release(before)
        if _are_stars(edges):
            break
        before = edges
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    linked = leaves.unionByName(centres)
    alone = links.filter("u = v").select(F.col("u").alias("node")).distinct().join(linked.select("node"), "node", "left_anti")
    return linked.unionByName(alone.select("node", F.col("node").alias("component")))
