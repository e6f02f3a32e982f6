"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored


def _finished(edges: DataFrame) -> bool:
    """True if every node has one edge at most and points at a node that has none."""
    n, nodes = edges.agg(F.count(F.lit(1)), F.countDistinct("a")).first()
    return n == nodes and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b, in any order. Per node that is not the smallest of its component: node, root (the smallest).

    Nodes must be comparable and not null; loops and repeated edges make no difference. Each round is written to the shared
    folder, which cuts the lineage. A step sends each edge to one of its ends and needs only the smallest neighbour of that
    end, an aggregate with map-side partial sums, so a node with very many edges is no more than a skewed join.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges)
    while not _finished(edges):
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
