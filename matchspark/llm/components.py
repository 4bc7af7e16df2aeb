"""Connected components of a table of links, by alternating star contraction.

Each round points every node at the smallest node it can see among its larger
and then its smaller neighbours, until every component is a star around its
smallest node. Only one row per node or link moves; minima are folded before
they are shuffled, so a node that a third of all links touch is no hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.session import cut


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest of its neighbours and itself."""
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = both.filter("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link the smaller neighbours of each node, and the node, to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.union(own).filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    """Number of links and an order-free digest of them."""
    row = links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))
    ).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(a, b): links between long nodes. Returns (node, component): every linked node, with its smallest.

    Nodes without a link, and links with a null end, give no row; a link of a node to itself
    is no link. Repeated links count once.
    """
    links = cut(links.select("a", "b").dropna().filter("a <> b").distinct(), "links")
    before = _state(links)
    while before[0]:
        links = cut(_small_star(_large_star(links)), "stars", links)
        after = _state(links)
        if after == before:
            break
        before = after
    ends = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(ends)
