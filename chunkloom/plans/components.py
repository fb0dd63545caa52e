"""Connected components by alternating large-star and small-star steps.

The published two-step scheme (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): each step replaces the neighbours of a node by
their minimum, so the graph shrinks to stars around the smallest node.  A node's minimum is a
plain aggregate (combined on the map side) joined back to the edges with
salted hubs, so no task ever holds all neighbours of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.plans.skew import join_salted
from chunkloom.session import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect each larger neighbour of a node to the node's minimum."""
    both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    lowest = both.groupBy("hi").agg(
        F.least(F.min("lo"), F.col("hi")).alias("root"), F.count(F.lit(1)).alias("n")
    )
    return join_salted(both.where("lo > hi"), lowest, "hi", F.col("lo")).select(
        F.col("lo").alias("hi"), F.col("root").alias("lo")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    lowest = edges.groupBy("hi").agg(F.min("lo").alias("root"), F.count(F.lit(1)).alias("n"))
    moved = (
        join_salted(edges, lowest, "hi", F.col("lo"))
        .where("lo != root")
        .select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
    )
    return moved.union(lowest.select("hi", F.col("root").alias("lo")))


def _is_settled(edges: DataFrame) -> bool:
    """True when every node either has one smaller neighbour or is a centre."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("centre")),
                F.struct(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("centre")),
            )
        ).alias("e")
    ).select("e.*")
    roles = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("centre").alias("centre"))
    return roles.where("ups > 1 OR (ups = 1 AND centre = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(hi, lo)`` with hi > lo -> ``(node, root)`` for every node that is
    not the smallest of its component."""
    current = materialize(edges.where("hi > lo").distinct())
    while not _is_settled(current):
        before, current = current, materialize(_small_star(_large_star(current).distinct()).distinct())
        discard(before)
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
