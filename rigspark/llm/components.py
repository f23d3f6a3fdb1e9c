"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .hot_keys import joined
from .spill import Scratch


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every edge's lower end goes on to the lowest neighbour of that."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), "m")
    ends = edges.groupBy("b").agg(F.count("*").alias("n")).select(F.col("b").alias("u"), "n")
    side = ends.join(least, F.col("u") == F.col("v"), "left").select("u", F.coalesce("m", "u").alias("m"), "n")
    return joined(edges, side, "b", "u", "n", total).select("a", F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node's lower neighbours, and itself, go to the lowest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("u"), "m", "n")
    moved = joined(edges, least, "a", "u", "n", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _kept(edges: DataFrame, name: str, scratch: Scratch) -> tuple[DataFrame, tuple[int, int]]:
    """The stored edges, their number and a fingerprint of them."""
    seen = Observation()
    table = scratch.stored(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), name)
    return table, (seen.get["n"], seen.get["x"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``: the smallest node that it reaches.

    Self-links only make their node appear.  Edges point from the greater node
    to the lesser.  Every round is a fixed number of joins and partial
    aggregations keyed by node; rounds grow with the logarithm of the longest
    path.  A hub's edges stay where they are (``hot_keys``); its minimum and
    number are taken map-side first.
    """
    ends, _ = _kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "ends", scratch)
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now, mark = _kept(ends.where("a <> b"), "star", scratch)
    while mark[0]:
        large, (total, _) = _kept(_large_star(now, mark[0]), "large", scratch)
        now, new = _kept(_small_star(large, total), "star", scratch)
        if new == mark:
            break
        mark = new
    stars = now.select(F.col("a").alias("n"), F.col("b").alias("label"))
    return nodes.join(stars, F.col("node") == F.col("n"), "left").select("node", F.coalesce("label", "node").alias("label"))
