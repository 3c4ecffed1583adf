"""Connected components of a link table by alternating large-star and small-star rounds.

Each round groups links by node and keeps, for a node, its smallest neighbour; both are aggregates
with a map-side combine followed by an equi-join, so no node's neighbours meet in one row. Rounds
are cut by reliable checkpoints; their number grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm._work import settle


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of a node moves to the node's smallest one. Small: the others, and the node."""
    seen = _both_ways(links) if large else links
    smallest = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = seen.join(smallest, "a")
    moved = joined.where(F.col("b") > F.col("a")) if large else joined.where(F.col("b") != F.col("m"))
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(smallest.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links to (node, root): each linked node with the smallest node it reaches.

    Unlinked nodes aren't listed. Links may repeat and point either way; loops and nulls are ignored.
    """
    links = links.where(F.col("a") != F.col("b"))
    links = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        links = settle(_star(_star(links, True), False))
        row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = tuple(row)
    raise RuntimeError(f"components still change after {max_rounds} rounds")
