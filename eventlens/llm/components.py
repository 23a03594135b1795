"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventlens.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour or itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(
        F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")
    )
    own = least.select(F.col("m").alias("a"), "b")
    return moved.union(own).where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every node of the links ``a, b``: the smallest node it is tied to.

    Alternating stars: each round is two joins on aggregated minima, so a node with very many links
    is only ever a join key whose other side has one row. Rounds grow with the logarithm of the
    longest path. Each round is checkpointed; the end is a round that changes nothing.
    """
    edges = cut(
        links.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    state = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(
                edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
            )
        state = seen
        edges = cut(_small_star(_large_star(edges)))
