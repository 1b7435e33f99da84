"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywake.llm.store import Scratch


def _pairs(df: DataFrame, u, v) -> DataFrame:
    return df.select(u.alias("u"), v.alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least of its neighbourhood."""
    both = edges.unionByName(_pairs(edges, F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _pairs(both.where("v > u").join(least, "u"), F.col("v"), F.col("m")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them; edges lead from the larger node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return (_pairs(joined.where("v <> m"), F.col("v"), F.col("m"))
            .unionByName(_pairs(least, F.col("u"), F.col("m"))).distinct())


def _done(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node hangs on one centre, and no centre hangs on another."""
    hung = edges.groupBy("u").agg(F.count("*").alias("times"))
    return hung.join(edges.select(F.col("v").alias("u"), F.lit(1).alias("centre")).distinct(), "u", "left").where(
        "times > 1 or centre is not null").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Stars (u, v) for all nodes of the edges (u, v) but the centres: v is the least node that u can reach.

    Loops and repeated edges are harmless; without edges the result is empty. Both steps are a minimum per
    node, combined before the shuffle, and a join that adaptive execution can split at a hot node.
    """
    edges = _pairs(edges.where("u <> v"), F.greatest("u", "v"), F.least("u", "v")).distinct()
    now = scratch.keep(edges, "edges")
    while not _done(now):
        after = scratch.keep(_small_star(_large_star(now)), "edges")
        scratch.drop(now)
        now = after
    return now


def labels(stars: DataFrame) -> DataFrame:
    """(node, component) of every node of the stars, centres included."""
    centres = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
