"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a group minimum and a join on the node, so no neighbour list is ever
collected; lineage is cut by a table per round, and rounds grow with the logarithm
of the size of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of a node to the least of them and itself: the larger ones, or the smaller ones."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on a link (u, v) between different longs.

    The component is the smallest node reachable.  Repeated and reversed links are
    fine; an empty table gives no rows.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        new = cut(_star(_star(now, True), False))
        # A forest of stars stays as it is: every u has one v, and no v is itself a u.
        same = new.count() == now.count() and new.join(now, ["u", "v"], "left_anti").isEmpty()
        drop(now)
        now = new
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
