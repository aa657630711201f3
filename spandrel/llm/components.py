"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Each step keeps the components and moves links towards the smallest member; a constant number of rows per link
crosses the network, and nothing is collected but a count. Written tables cut the lineage between steps. The join on a large star's centre is an
inner sort-merge join, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    out = both.join(low, "a").filter(F.col("b") > F.col("a"))
    return out.select(F.col("low").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    joined = down.join(low, "u")
    out = joined.select(F.col("low").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("low").alias("a"), F.col("u").alias("b")))
    return out.filter("a <> b").distinct()


def _mark(edges: DataFrame):
    """What changes as long as the steps do."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1_000_003))).first()
    return r[0], r[1]


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, component): every node that has a link, with the smallest node it is linked to by any path.

    edges: columns a and b of one orderable type; order, repeats and links to oneself don't matter.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "cc")
    mark = _mark(now)
    for _ in range(most_steps):
        if not mark[0]:
            break
        now = stored(_small_star(_large_star(now)), "cc")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
