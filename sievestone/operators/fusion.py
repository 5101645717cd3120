"""Reciprocal rank fusion and the candidate pool."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF = 60


def pool_size(k: int, filtered: bool, hybrid: bool = False) -> int:
    """Candidates to retrieve before filters and caps."""
    own = max(10 * k, 100) if filtered else k
    return max(4 * k, 50, own) if hybrid else own


def ranked(hits: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Positions from 1; hits are a pool, bounded by its size."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def rrf(lists: list[DataFrame], keys: list[str], k: int | None = None) -> DataFrame:
    """Lists with the key columns, a rank from 1 and payload: summed 1 / (60 + rank), the first list's payload kept.

    The lists are pools of bounded size; the result is in order of score, then keys.
    """
    rest = [c for c in lists[0].columns if c not in (*keys, "rank")]
    tagged = [x.select(*keys, F.lit(i).alias("list"), "rank", *rest) for i, x in enumerate(lists)]
    fused = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"), *(F.min_by(c, "list").alias(c) for c in rest if c != "score"))
    fused = fused.orderBy(F.desc("score"), *keys)
    return fused if k is None else fused.limit(k)
