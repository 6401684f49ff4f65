"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import join_frequent
from tidemark.shared import discard


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each neighbour above a node gets the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    return join_frequent(both.where("v > u"), least, ["u"], 2 * total).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below get the least of those neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    below = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return below.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every upper end has one lower end, which is no upper end itself."""
    upper = edges.select(F.col("a").alias("x"), F.lit(1).alias("ups"), F.lit(0).alias("downs"))
    lower = edges.select(F.col("b").alias("x"), F.lit(0).alias("ups"), F.lit(1).alias("downs"))
    ends = upper.unionByName(lower).groupBy("x").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return ends.where("ups > 1 or ups = 1 and downs = 1").isEmpty()


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; a component's name is its least node.

    ``edges``: (a, b) of an integer type, in any direction, loops and repeats allowed; edges with
    a null end are left out. ``cut`` writes a table where it outlives its executors and reads it
    again: each round is one such table. Neighbour lists are never gathered: the least of them is an
    aggregate with partial sums, and a node of very many edges (the centre of a large star) gets
    it by broadcast, so that such a node is no single task's. After a large star all neighbours
    above a node hang on one node each, so the small star has few edges for each upper end.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(now)
    for _ in range(max_rounds):
        if _only_stars(now):
            break
        was, now = now, cut(_small_star(_large_star(now, now.count())))
        discard(was)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(root)
