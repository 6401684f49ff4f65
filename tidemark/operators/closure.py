"""Reachability over edge tables: plain closures with hops, and first-in-first-out searches.

A level is one job over the frontier only: the frontier meets the edges, what is new is kept,
and the level is written to the shared folder. ``visited`` is a union of those tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import cut, discard


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Nodes reached from seeds with the least number of hops.

    edges: (src, dst); seeds: (node) and any key columns, each key being a search of its own.
    Gives the seeds' columns and ``hops``.
    """
    keys = [c for c in seeds.columns if c != "node"]
    edges = cut(edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst")).distinct())
    level = cut(seeds.distinct().withColumn("hops", F.lit(0).cast("long")))
    levels, hops = [level], 0
    while (max_hops is None or hops < max_hops) and not level.isEmpty():
        hops += 1
        visited = reduce(DataFrame.unionByName, levels).select(*keys, "node")
        found = level.join(edges, F.col("node") == F.col("__src")).select(*keys, F.col("__dst").alias("node")).distinct()
        level = cut(found.join(visited, [*keys, "node"], "left_anti").withColumn("hops", F.lit(hops).cast("long")))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def least_sources(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, source): of the sources that reach a node, itself included, the least.

    Labels travel, not searches: a node is told on only when its label gets less, so that one
    pass over the graph serves all sources, however many.
    """
    edges = cut(edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst")).distinct())
    first = known = level = cut(sources.select("node", F.col("node").alias("source")).distinct())
    while not level.isEmpty():
        told = level.join(edges, F.col("node") == F.col("__src")).groupBy(F.col("__dst").alias("node")).agg(F.min("source").alias("source"))
        level = cut(told.join(known.withColumnRenamed("source", "was"), "node", "left").where("was is null or source < was").select("node", "source"))
        was, known = known, cut(known.join(level.select("node"), "node", "left_anti").unionByName(level))
        if was is not first:
            discard(was)
    return known


def search(edges: DataFrame, anchors: DataFrame, marks: DataFrame, complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """First-in-first-out search of many anchors at once.

    edges: (src, dst, ord), anchors: (anchor, node, pos), marks: (node). Returns ``visited``
    (anchor, node, parent, at) and ``hits`` (anchor, node, at): at most one for each anchor. ``at``
    is the place in the queue. A node is tested when it is taken from the queue, so the hit is
    the marked node of the least place, and visited are the nodes that had been put into the
    queue by then; without a hit, all that can be reached. ``complete`` goes on after hits.
    """
    marks = marks.select("node").distinct()
    first = Window.partitionBy("anchor", "node").orderBy("pos")
    level = anchors.withColumn("r", F.row_number().over(first)).where("r = 1")
    level = cut(level.select("anchor", "node", F.lit(None).cast(anchors.schema["node"].dataType).alias("parent"), (F.row_number().over(Window.partitionBy("anchor").orderBy("pos")) - 1).cast("long").alias("at")))
    levels = [level]
    hits = level.select("anchor", "node", "at").limit(0)
    while not level.isEmpty():
        met = level.join(marks, "node", "left_semi").groupBy("anchor").agg(F.min_by("node", "at").alias("node"), F.min("at").alias("at"))
        met = cut(met)
        hits = hits.unionByName(met.join(hits.select("anchor"), "anchor", "left_anti"))
        going = level.join(met.select("anchor", F.col("at").alias("hit")), "anchor", "left")
        if not complete:  # what stands in the queue behind the hit is never taken from it
            going = going.where("hit is null or at < hit")
        visited = reduce(DataFrame.unionByName, levels).groupBy("anchor").agg(F.max("at").alias("last"))
        found = going.join(edges, going["node"] == edges["src"]).select("anchor", F.col("dst").alias("node"), F.col("src").alias("parent"), "at", "ord")
        found = found.join(reduce(DataFrame.unionByName, levels).select("anchor", "node"), ["anchor", "node"], "left_anti")
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("anchor", "node").orderBy("at", "ord"))).where("r = 1")
        place = F.row_number().over(Window.partitionBy("anchor").orderBy("at", "ord"))
        done = level.sparkSession.createDataFrame([], met.schema) if complete else met
        found = found.withColumn("n", place).join(visited, "anchor").select("anchor", "node", "parent", (F.col("last") + F.col("n")).cast("long").alias("at"))
        next_level = cut(found)
        levels.append(next_level)
        # anchors with a hit stop here: their children are known, but never taken
        level = next_level if complete else next_level.join(done.select("anchor"), "anchor", "left_anti")
    return reduce(DataFrame.unionByName, levels), hits


def witness(visited: DataFrame, hits: DataFrame) -> DataFrame:
    """(anchor, path): nodes from the anchor to the hit, along the parents."""
    walk = hits.select("anchor", F.array("node").alias("path"), "node")
    done = None
    while True:
        step = cut(walk.join(visited.select("anchor", "node", "parent"), ["anchor", "node"]))
        ended = step.where("parent is null").select("anchor", "path")
        done = ended if done is None else done.unionByName(ended)
        walk = step.where("parent is not null").select("anchor", F.concat(F.array("parent"), "path").alias("path"), F.col("parent").alias("node"))
        if walk.isEmpty():
            return done


def least_fixpoint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes proven by their targets: those all of whose edges lead to proven nodes. Leaves are
    proven first; what is on a cycle, or leads to one, never is."""
    edges = edges.select("src", "dst").distinct()
    proven = cut(nodes.select("node").distinct().join(edges, F.col("node") == F.col("src"), "left_anti"))
    parts, new = [proven], proven
    open_ = cut(edges)
    while not new.isEmpty():
        left = cut(open_.join(new, open_["dst"] == new["node"], "left_anti"))
        new = cut(open_.select("src").distinct().join(left.select("src").distinct(), "src", "left_anti").select(F.col("src").alias("node")))
        parts.append(new)
        open_ = left
    return reduce(DataFrame.unionByName, parts)
