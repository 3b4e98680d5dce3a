"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the smaller ones and itself) link to its smallest neighbour."""
    both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long): the smallest node that it reaches.

    With ``rounds``, it stops after so many: equal labels then still mean a connection, but not all connected nodes have one.

    No group is collected: stars are an aggregate and a join back, so a node with very many links is split by adaptive
    execution. Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    one = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    current, seen, done = written(one, "links"), None, 0
    while rounds is None or done < rounds:
        done += 1
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        following = written(_star(_star(current, True), False), "links")
        drop(current)
        current = following
    both = current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return both.groupBy("node").agg(F.min("component").alias("component"))
