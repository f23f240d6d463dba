"""Connected components of a links table, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.session import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one parent, or is a parent and has none."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("kind")).union(edges.select(F.col("b").alias("x"), F.lit(2).alias("kind")))
    seen = ends.groupBy("x").agg(F.bit_or("kind").alias("kinds"), F.count_if(F.col("kind") == 1).alias("parents"))
    return seen.where("kinds = 3 OR parents > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of `links` (a, b: long): label is the least node reachable.

    Large-star and small-star rounds: each links nodes to the least neighbour
    seen, until the edges are stars. A node's neighbours are never gathered:
    minima combine before the shuffle, and a hot node's rows are only joined.
    The edges of each round are written to the shared folder, so a round starts
    from files and not from all rounds before. NULL ends and loops are dropped.
    """
    spark = links.sparkSession
    edges = cut(spark, links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct(), "edges")
    while not _all_stars(edges):
        both = _both_ways(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        edges = cut(spark, small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
                    .where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
