"""Connected components by alternating large-star and small-star rounds, with hot stars left to adaptive joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (u bigint, v bigint) to (node, root): every node on an edge, with the smallest node that it reaches.

    Each round shuffles the edges by their ends and checkpoints them, until a round changes nothing; the rounds grow
    with the logarithm of the longest path. No edges give no rows; loops and repeated edges change nothing.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        e = cut(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct())
        low = cut(e.groupBy("u").agg(F.min("v").alias("m")))
        e = cut(e.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    nodes = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
