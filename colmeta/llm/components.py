"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large star) or smaller (small star) neighbours to the smallest node around it.

    The minima are dealt anew before they meet the edges: a join right after their aggregation could not be split at a hub.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least.hint("rebalance"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least.hint("rebalance"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Label every node that has an edge with the smallest node it reaches.

    edges: u, v (long, no nulls; loops and repeats allowed). Returns node, label, without lone nodes. A star's hub may
    hold any share of the edges: nodes meet their neighbours by joins and mergeable minima, never as a list.
    The number of steps grows with the logarithm of a component's size.
    """
    now = stored(edges.select("u", "v").where("u <> v").distinct())
    was = None
    while True:
        tall = stored(_star(now, large=True))
        new = stored(_star(tall, large=False))
        dropped(now, tall)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = new
        if state == was:
            break
        was = state
    return now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("label"))
