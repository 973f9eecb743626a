"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.llm.common import scalar, written


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected edges ``(a, b)``; the root is the smallest node.

    Each round every node points at the smallest node it knows, then every edge is moved to the pointed-at
    nodes and edges inside a group fall away. Rounds are few (the longest path halves at least) and each
    is one written table; only a row count comes to the driver.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "cc-edges")
    found = None
    while edges.limit(1).count():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        points = written(least.select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-points")
        points = shortened(points)
        if found is None:
            found = points
        else:
            moved = points.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            found = found.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
            found = written(found, "cc-found")
        left = points.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        right = points.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        moved = edges.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        edges = written(moved.filter("a <> b").distinct(), "cc-edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def shortened(points: DataFrame) -> DataFrame:
    """Follow the pointers ``(node, root)`` to their ends; each round doubles the steps."""
    while True:
        ends = points.select(F.col("node").alias("root"), F.col("root").alias("_end"))
        longer = written(points.join(ends, "root").select("node", "root", F.col("_end")), "cc-jump")
        if not scalar(longer.agg(F.sum((F.col("root") != F.col("_end")).cast("long")))):
            return points
        points = longer.select("node", F.col("_end").alias("root"))
