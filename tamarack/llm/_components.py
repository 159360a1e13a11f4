"""Connected components of a link table, by rounds of star contraction.

Each round links every node's larger neighbours, and then its smaller ones, to
the smallest node it sees.  Links only ever move towards smaller nodes; when a
round changes nothing, every node hangs on its component's smallest node.  The
rounds grow with the logarithm of the longest chain.  Links stay on the
executors; each round is a written table, and the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: a node's larger neighbours go to the least of it and its neighbours.
    Small: the same for its smaller neighbours and itself."""
    near = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Written, so that the join's sides are plain shuffles, which adaptive
    # execution splits where one node has most of the links.
    near = written(near, "links-near")
    least = written(near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m")), "links-least")
    met = near.join(least, "u")
    if large:
        return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); component is the smallest node."""
    now = written(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        now = written(_star(_star(now, True), False).distinct(), "links")
        seen = tuple(now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state or not seen[0]:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
