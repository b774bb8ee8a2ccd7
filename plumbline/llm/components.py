"""Connected components by alternating large-star and small-star steps; all state is in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _star(arcs: DataFrame, nodes_above: bool) -> DataFrame:
    """arcs(u, v). Each u moves its arcs to the least of itself and its neighbours."""
    # written, so that the session may split the arcs of a hub in the join
    least = written(arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    moved = arcs.join(least, "u")
    if nodes_above:
        return moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v"))).filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """`(node, root)` for every node of `edges(a, b)` (longs); root is the least node of its component.

    Each round keeps at most one arc a node and neighbour; rounds grow with the logarithm of the
    longest path. Loops and repeated edges are allowed; no edges give no rows.
    """
    down = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    arcs = written(edges.filter("a <> b").select(*down).distinct(), "arcs")
    nodes = arcs
    state = None
    while True:
        both = arcs.union(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_star(both, nodes_above=True).distinct(), "arcs")
        arcs = written(_star(large, nodes_above=False).distinct(), "arcs")
        now = tuple(arcs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = arcs.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    every = nodes.select(F.col("u").alias("node")).union(nodes.select(F.col("v").alias("node"))).distinct()
    return every.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
