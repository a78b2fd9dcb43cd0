"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.staging import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """The least node of each node's component: columns ``node`` and ``root``.

    ``edges`` has long columns ``a`` and ``b``. In each round every node of the contracted
    graph points to the least of itself and its neighbours, pointers are followed once, and
    the edges are contracted; rounds end when no edge is left. Nodes in no edge are absent.
    """
    live = stage(edges.filter("a <> b").select("a", "b").distinct())
    roots: DataFrame | None = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("least"))
        parent = near.select(F.col("a").alias("node"), F.least("a", "least").alias("up"))
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = stage(
            parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        )
        if roots is None:
            roots = parent.select("node", F.col("up").alias("root"))
        else:
            step = parent.select(F.col("node").alias("root"), "up")
            roots = stage(
                roots.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            )
        left = parent.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = parent.select(F.col("node").alias("b"), F.col("up").alias("y"))
        live = stage(
            live.join(left, "a").join(right, "b").filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
    if roots is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
