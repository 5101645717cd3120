"""Exact nearest neighbours: filter, distance, top k; for one query vector or for many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.vectors import DISTANCES
from ..session import map_arrow
from .lexical import top

MAX_DIM = 8192


def check_query(vector: list[float], k: int) -> None:
    if k < 0:
        raise ValueError("k must not be negative")
    if not 0 < len(vector) <= MAX_DIM:
        raise ValueError(f"a vector has 1 to {MAX_DIM} elements")


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | None = None, column: str = "embedding", order: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The k rows nearest to the query among those that `where` admits, with distance; ties by the order columns."""
    check_query(query, k)
    rows = vectors.filter(F.col(column).isNotNull() if where is None else where & F.col(column).isNotNull())
    q = F.array(*(F.lit(float(x)) for x in query))
    return top(rows.withColumn("distance", DISTANCES[metric](F.col(column), q)), k, *order, by="distance", ascending=True)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", column: str = "embedding", key: str = "vec_id", block: int = 4096) -> DataFrame:
    """query_id, key, distance, rank: for each query (query_id, q) its k nearest; keys of any type that sorts.

    Queries go to every task in blocks of at most `block`, one pass over the vectors for each. A task keeps k rows for
    each query while it reads, so only tasks * queries * k rows are shuffled, never all pairs. Distances are ranked at
    12 decimals, then by key; a zero vector's cosine is null and ranks last. Rows and queries without a vector are left
    out; no queries give no rows. Repeated query_ids give their rows together, ranked as one query.
    """
    schema = StructType([queries.schema["query_id"], vectors.schema[key], StructField("distance", DoubleType())])
    out = None
    for ids, matrix in _blocks(queries, block):
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))
        near = map_arrow(vectors.select(key, column), lambda batches, shared=shared: _nearest(batches, *shared.value, k, metric, key, column), schema)
        out = near if out is None else out.unionByName(near)
    near = vectors.sparkSession.createDataFrame([], schema) if out is None else out
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), key)
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The queries that have a vector, some at a time on the driver."""
    held: list = []
    kind = to_arrow_type(queries.schema["query_id"].dataType)
    pack = lambda rows: (pa.array([r["query_id"] for r in rows], kind), np.array([r["q"] for r in rows], np.float64))
    for row in queries.filter("q is not null").select("query_id", "q").toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield pack(held)
            held = []
    if held:
        yield pack(held)


def _nearest(batches: Iterator[pa.RecordBatch], ids: pa.Array, q: np.ndarray, k: int, metric: str, key: str, column: str) -> Iterator[pa.RecordBatch]:
    """The k nearest of a task's rows for each query. Keys are kept beside the matrix, by number, so they may be of any type."""
    best_d, best_n, keys = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64), None
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(column)))
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            v = np.array(part.column(column).to_pylist(), np.float64)
            d = np.hstack([best_d, np.nan_to_num(np.round(_distances(q, v, metric), 12), nan=np.inf)])
            keys = part.column(key) if keys is None else pa.concat_arrays([keys, part.column(key)])
            new = np.broadcast_to(np.arange(len(keys) - len(v), len(keys)), (len(ids), len(v)))
            order = np.empty(len(keys), np.int64)
            order[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
            n = np.hstack([best_n, new])
            by = np.lexsort((order[n], d), axis=1)[:, :k]
            best_d, best_n = np.take_along_axis(d, by, 1), np.take_along_axis(n, by, 1)
            used, flat = np.unique(best_n, return_inverse=True)  # of the keys, those still needed
            keys, best_n = keys.take(pa.array(used)), flat.reshape(best_n.shape)
    if keys is not None:
        d = best_d.ravel()
        at = pa.array(np.repeat(np.arange(len(ids)), best_n.shape[1]))
        yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(pa.array(best_n.ravel())), pa.array(d, mask=np.isinf(d))], ["query_id", key, "distance"])


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """All distances between the rows of two matrices."""
    if metric == "l1":
        return np.stack([np.abs(v - x).sum(axis=1) for x in q])
    dots = q @ v.T
    if metric == "l2":
        return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * dots))
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dots / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((v * v).sum(1))[None, :]


def semantic(vectors: DataFrame, embed, query: str, k: int, prefix: str = "", **options) -> DataFrame:
    """Nearest rows to an embedded query text; score is 1 less the cosine distance. embed: texts to vectors."""
    import unicodedata

    vector = embed([unicodedata.normalize("NFC", prefix + query)])[0]
    norm = sum(x * x for x in vector) ** 0.5
    vector = vector if norm < 1e-12 else [x / norm for x in vector]
    return knn(vectors, vector, k, **options).withColumn("score", 1 - F.col("distance"))
