"""Connected components of an undirected edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import dropped, saved


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links each neighbour (the larger ones, or all not larger) of a node to the smallest node of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = both.join(low, "a")
    if larger:
        out = out.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        out = out.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(low.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Nodes are longs; self-loops and null ends are ignored, repeated edges harmless. No edge list reaches the driver: only the
    number of edges and a checksum, which tell that a round changed nothing. Raises if ``max_rounds`` are not enough.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        before, edges = edges, saved(_star(_star(edges, True), False), "edges")
        dropped(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
