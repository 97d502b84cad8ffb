"""Connected components of a graph too large for any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _nearest(pairs: DataFrame) -> DataFrame:
    """Each node with its smallest neighbour; the aggregation combines before it shuffles."""
    return pairs.groupBy("a").agg(F.min("b").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(_nearest(both), "a").where("b > a")
    return linked.select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _nearest(down)
    rest = down.join(low, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return rest.union(low.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns a and b. Returns node and root, the smallest node it is joined to.

    Alternating large and small stars: every node is hooked to the smallest
    node it knows until only stars are left, in a number of rounds that grows
    with the logarithm of the longest path. A round is written to the shared
    folder, so a lost executor costs one round at most. Roots themselves are
    not listed. Loops (a = b) are ignored.
    """
    edges = staged(edges.where("a != b").select("a", "b").distinct(), "links")
    while True:
        after = staged(_small_star(_large_star(edges)), "stars")
        said = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first() for x in (edges, after)]
        edges = after
        if said[0] == said[1]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
