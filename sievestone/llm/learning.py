"""Shared by the learned scores: the bounded sample of labelled rows, and isotonic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of


def learnable(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """doc_id and __label of the rows outside the held fold; an id with several labels counts once, with the largest."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held))
    return rows.groupBy("doc_id").agg(F.max(label).alias("__label"))


def class_sizes(labels: DataFrame, label: str, folds: int, held: int) -> dict[int, int]:
    """How many rows of either class are outside the held fold."""
    got = learnable(labels, label, folds, held).groupBy("__label").agg(F.count("*").alias("n")).collect()
    return {r["__label"]: r["n"] for r in got}


def sample_of(labels: DataFrame, label: str, folds: int, held: int, each: int) -> DataFrame:
    """doc_id and label of at most `each` rows of either class outside the held fold, by the order of a hash of the id.

    An id with several labels counts once, with the largest.
    """
    rows = learnable(labels, label, folds, held)
    part = lambda y: rows.filter(F.col("__label") == y).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(each)
    return part(0).unionByName(part(1))


def labelled(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text, __label of the sampled documents; the sample is broadcast, as its size is bounded by its parameter."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability) to interpolate between; equal scores are pooled first."""
    at, of = np.unique(score, return_inverse=True)
    mass = np.bincount(of, weight, len(at))
    hits = np.bincount(of, label * weight, len(at))
    blocks: list[list[float]] = []  # weighted label sum, weight, weighted score sum
    for s, y, w in zip(at, hits, mass, strict=True):
        blocks.append([y, w, s * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
