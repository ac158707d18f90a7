"""Walks over edges (src, type, dst).

A walk of few steps is a chain of equi-joins that Catalyst plans as a whole. A deeper one goes level by level, writes
each frontier out and ends when no new node appears, so that a depth far beyond the graph's costs nothing. Directed
walks keep the set of reached nodes with the least depth; walks that need whole paths carry the edges they have used,
as no edge may repeat on a path while nodes may.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import few, stored

#: Steps up to which a walk is one plan.
CHAINED = 2


def check_depth(depth: int) -> int:
    if isinstance(depth, bool) or not isinstance(depth, int) or depth < 1:
        raise ValueError("depth must be an integer of at least 1")
    return depth


def of_types(edges: DataFrame, types: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    if types:
        edges = edges.where(F.col("type").isin(list(types)))
    if prefix:
        edges = edges.where(F.col("type").startswith(prefix))
    return edges


def reverse(edges: DataFrame) -> DataFrame:
    turned = {"src": "dst", "dst": "src"}
    return edges.select(*(F.col(turned.get(c, c)).alias(c) for c in edges.columns))


def walk(anchors: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """anchor, node, depth (the least) of all nodes within depth steps; anchors: a column anchor."""
    if check_depth(depth) > CHAINED:
        return closure(anchors, edges, depth)
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    level = anchors.select("anchor", F.col("anchor").alias("node")).distinct()
    levels = []
    for n in range(1, depth + 1):
        level = level.join(step, "node").select("anchor", F.col("next").alias("node")).distinct()
        levels.append(level.withColumn("depth", F.lit(n)))
    return reduce(DataFrame.union, levels).groupBy("anchor", "node").agg(F.min("depth").alias("depth"))


def closure(anchors: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """walk() level by level, without a bound if no depth is given."""
    step = stored(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    level = anchors.select("anchor", F.col("anchor").alias("node")).distinct()
    levels: list[DataFrame] = []
    while True:
        level = few(level).join(step, "node").select("anchor", F.col("next").alias("node")).distinct()
        if levels:
            level = level.join(reduce(DataFrame.union, levels), ["anchor", "node"], "left_anti")
        level = stored(level.select("anchor", "node", F.lit(len(levels) + 1).alias("depth")))
        if level.isEmpty():
            return reduce(DataFrame.union, levels) if levels else level
        levels.append(level)
        if len(levels) == depth:
            return reduce(DataFrame.union, levels)


def paths(anchors: DataFrame, edges: DataFrame, depth: int, both: bool = False) -> DataFrame:
    """anchor, node, depth, path (nodes), types: one row per path; no edge twice on a path."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "type", F.xxhash64("src", "type", "dst").alias("edge"))
    step = out.union(edges.select("dst", "src", "type", F.xxhash64("src", "type", "dst"))) if both else out
    empty = F.array().cast("array<string>")
    level = anchors.select("anchor", F.col("anchor").alias("node"), F.array("anchor").alias("path"), empty.alias("types"), F.array().cast("array<bigint>").alias("used")).distinct()
    levels = []
    for n in range(1, check_depth(depth) + 1):
        level = level.join(step, "node").where(~F.array_contains("used", F.col("edge"))).select("anchor", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.concat("types", F.array("type")).alias("types"), F.concat("used", F.array("edge")).alias("used"))
        if depth > CHAINED:
            level = stored(level)
            if level.isEmpty() and levels:
                break
        levels.append(level.withColumn("depth", F.lit(n)))
    return reduce(DataFrame.union, levels).select("anchor", "node", "depth", "path", "types")


def shortest_paths(anchors: DataFrame, targets: DataFrame, edges: DataFrame, hops: int = 6) -> DataFrame:
    """anchor, node, hops, path, types of one undirected shortest path to each target (a column node).

    Each level keeps one way to every node that is new to its anchor: the least by edge type and node before it.
    """
    e = edges.select("src", "type", "dst")
    step = stored(e.union(e.select("dst", "type", "src")).distinct().toDF("node", "type", "next"))
    none = F.array().cast("array<string>")
    level = anchors.select("anchor", F.col("anchor").alias("node"), F.array("anchor").alias("path"), none.alias("types")).distinct()
    levels = [level]
    for _ in range(check_depth(hops)):
        ways = level.join(step, "node").select("anchor", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.concat("types", F.array("type")).alias("types"))
        best = ways.groupBy("anchor", "node").agg(F.min(F.struct("types", "path")).alias("w")).select("anchor", "node", "w.path", "w.types")
        seen = reduce(DataFrame.union, [x.select("anchor", "node") for x in levels])
        level = stored(best.join(seen, ["anchor", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
    found = reduce(DataFrame.union, levels[1:]) if len(levels) > 1 else levels[0].where("false")
    return found.join(targets.select("node").distinct(), "node", "left_semi").select("anchor", "node", F.size("types").alias("hops"), "path", "types")


def shortest(anchors: DataFrame, targets: DataFrame, edges: DataFrame, hops: int = 6) -> DataFrame:
    """anchor, node, hops of an undirected shortest path to each target (a column node)."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return walk(anchors, both, hops).join(targets, "node", "left_semi").select("anchor", "node", F.col("depth").alias("hops"))
