"""Connected components of an undirected link table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or hangs on exactly one root."""
    ends = (edges.select(F.col("a").alias("u"), F.lit(1).alias("hangs"), F.lit(0).alias("root"))
            .unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("hangs"),
                                      F.lit(1).alias("root"))))
    odd = (ends.groupBy("u").agg(F.sum("hangs").alias("hangs"), F.max("root").alias("root"))
           .filter("hangs > 1 or (hangs = 1 and root = 1)"))
    return not odd.limit(1).collect()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long): component is the smallest
    reachable node.

    Alternating star contraction: a large-star round hangs each node's larger neighbours on its
    smallest one, a small-star round its smaller ones. Each round is a grouped minimum (partial
    aggregation, so a hub costs no more than its tasks) and an equi-join that AQE can split; the
    links are written after every round. Ends when the links are stars around the smallest
    nodes."""

    def both(e):
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a <> b").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if _is_stars(edges):
            break
        pairs = both(edges)
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (pairs.filter("v > u").join(least, "u").select(F.col("v").alias("a"),
                                                               F.col("m").alias("b"))
                 .filter("a <> b"))
        # small star: every link already runs from the larger node a to a smaller one b
        hung = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        edges = materialize(
            hung.select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"),
                        F.col("m").alias("b")).filter("a <> b").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
