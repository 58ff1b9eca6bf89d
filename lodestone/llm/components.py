"""Distributed connected components by contraction: every step is a join or an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import stored


def _roots(parent: DataFrame) -> DataFrame:
    """Pointer jumping: ``parent(node, up)`` with ``up <= node`` becomes ``node, root``."""
    while True:
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = stored(parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("next"), "up"))
        parent = jumped.select("node", F.col("next").alias("up"))
        if jumped.filter("next <> up").isEmpty():
            return parent.withColumnRenamed("up", "root")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``: the smallest node reachable from it.

    Each round every node points at its smallest neighbour (or at itself), pointers are followed
    to their ends, and edges are redrawn between the ends; at least half of what is still joined
    to something goes away, so rounds grow with the logarithm of the input.  Loops, repeated and
    reversed edges are fine; edges with a null end are ignored; no edges give no rows.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, labels = stored(edges.distinct()), None
    while True:
        both = edges.union(edges.select("b", "a"))
        parent = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")))
        roots = _roots(parent)
        if labels is None:
            labels = roots.select("node", F.col("root").alias("component"))
        else:
            up = roots.select(F.col("node").alias("component"), "root")
            labels = stored(labels.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        ends = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = stored(ends.filter("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
        if edges.isEmpty():
            return labels
