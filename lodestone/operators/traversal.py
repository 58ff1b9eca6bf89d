"""Bounded, level-by-level traversal of any edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.lineage import written


def levels(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``node, level, uncertain`` of what is reached from ``start(node)`` over ``edges(src, dst, certain)``.

    A node comes at its first level only, uncertain if every arrival there is: over an uncertain node or
    edge.  Each level is one join, written out, so lineage stays short; it ends early when a level is empty.
    """
    frontier = written(start.select("node", F.lit(0).alias("level"), F.lit(False).alias("uncertain")).dropDuplicates(["node"]))
    seen, found = frontier.select("node"), None
    for level in range(1, depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("uncertain") | ~F.col("certain")).alias("uncertain"))
        new = step.groupBy("node").agg(F.bool_and("uncertain").alias("uncertain")).join(seen, "node", "left_anti")
        frontier = written(new.select("node", F.lit(level).alias("level"), "uncertain"))
        found = frontier if found is None else found.unionByName(frontier)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("node"))
    if found is None:
        return frontier.filter("false")
    return found


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "certain")


def callers(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """Who is affected by ``start``: traversal against the edges."""
    return levels(reversed_edges(edges), start, depth)


def callees(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    return levels(edges, start, depth)
