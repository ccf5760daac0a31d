"""Connected components and chains of steps over tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def follow(steps: DataFrame) -> DataFrame:
    """(key, to) with every chain of steps followed to its end; each round doubles the length followed, until nothing
    changes. The steps must not form rings."""
    while True:
        onward = steps.select(F.col("key").alias("to"), F.col("to").alias("further"))
        longer = cut(steps.join(onward, "to", "left").select("key", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        steps = longer.drop("moved")
        if not longer.filter("moved").limit(1).count():
            return steps


def components(links: DataFrame) -> DataFrame:
    """(node, place) of the nodes of ``links`` (node_a, node_b): the least node of the connected component.

    Each node takes the least of its neighbours and itself; links between nodes that then differ, few unless components are
    long, are contracted and treated alike until none is left, and the steps are followed to their ends.
    """
    both = cut(links.unionByName(links.select(F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b"))))
    least = lambda e: e.groupBy(F.col("node_a").alias("node")).agg(F.least(F.min("node_b"), F.first("node_a")).alias("to"))
    first = cut(least(both))
    steps, edges, low = None, both, first
    while True:
        left = edges.join(low.select(F.col("node").alias("node_a"), F.col("to").alias("a")), "node_a").join(low.select(F.col("node").alias("node_b"), F.col("to").alias("b")), "node_b")
        edges = cut(left.filter("a <> b").select(F.col("a").alias("node_a"), F.col("b").alias("node_b")).distinct())
        if not edges.limit(1).count():
            break
        low = cut(least(edges))
        moved = low.filter("node <> to").select(F.col("node").alias("key"), "to")
        steps = moved if steps is None else steps.unionByName(moved)
    if steps is None:
        return first.withColumnRenamed("to", "place")
    # A label may move in several rounds, always to a lesser one of its component: any of these will do.
    ends = follow(cut(steps.groupBy("key").agg(F.min("to").alias("to"))))
    return first.join(ends.select(F.col("key").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("place"))
