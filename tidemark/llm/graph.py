"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _settled(edges: DataFrame) -> bool:
    """Whether every node that points somewhere points to one node that points
    nowhere: then each target is the smallest of its component."""
    targets = edges.groupBy("a").agg(F.count("*").alias("n"))
    loose = targets.where("n > 1").select("a").unionByName(edges.join(targets.select(F.col("a").alias("b")), "b", "left_semi").select("a"))
    return not loose.limit(1).count()


def _star(arcs: DataFrame) -> DataFrame:
    """For rows (u, v): u and the smallest of u and all its v."""
    return arcs.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("centre"), F.least("u", "least").alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """From undirected edges (a, b) of one orderable type to rows (node,
    component), component being its smallest node.

    Nodes without an edge to another node do not appear. Each round writes its
    edges to the shared folder; a node of any degree costs one row per edge.
    """
    now = cut_lineage(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(_star(both), F.col("u") == F.col("centre")).where("v > u AND v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        # Every arc now points from the larger node to the smaller one.
        small = large.join(_star(large), F.col("u") == F.col("centre"))
        star = small.select(F.col("v").alias("a"), F.col("least").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("least").alias("b")))
        now = cut_lineage(star.where("a <> b").distinct(), "edges")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
