"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an aggregate for the smallest neighbour and a join that hangs the neighbours on it; no
neighbour list is gathered, a hub's rows can be split over tasks, and the number of rounds grows with
the logarithm of the longest path. Rounds are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every larger neighbour of u is hung on the smallest of u and its neighbours; else every smaller one, and u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.join(least, "u")
    if large:
        return hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and those on none: then each star is a component."""
    one = F.lit(1)
    ends = edges.select(F.col("u").alias("node"), one.alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), one.alias("holds")))
    wrong = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 OR (hangs = 1 AND holds = 1)")
    return wrong.agg(F.count(one)).first()[0] == 0


def connected_components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component) of every node with an edge to another; component is the smallest node."""
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    while True:
        # a round leaves every edge with its smaller node second
        now = materialise(_star(_star(now, large=True), large=False), "edges")
        if _are_stars(now):
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
