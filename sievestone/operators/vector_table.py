"""Declared vector tables: typed vector columns with partition keys, metadata and auxiliary columns.

A declaration is a list like "id integer primary key, embedding float[4] distance_metric=cosine, label integer partition
key, name text, +note text, chunk_size=1024". Tables are values: insert, update and delete give a new one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import DISTANCES
from .lexical import top

#: Limits of a declaration, and SQL types of scalar columns.
MAX_VECTORS, MAX_PARTITIONS, MAX_AUX, MAX_METADATA, MAX_DIM, MAX_K, MAX_CHUNK = 16, 4, 16, 16, 8192, 4096, 4096
SCALARS = {"text": "string", "integer": "bigint", "int": "bigint", "float": "double", "double": "double", "boolean": "boolean", "bool": "boolean"}
VECTORS = {"float": "array<float>", "f32": "array<float>", "int8": "array<tinyint>", "i8": "array<tinyint>", "bit": "array<tinyint>"}
_VECTOR = re.compile(r"(\w+)\s+(float|f32|int8|i8|bit)\s*\[\s*(\d+)\s*\](?:\s+distance_metric\s*=\s*(\w+))?$", re.IGNORECASE)
_SCALAR = re.compile(r"(\+?)\s*(\w+)\s+(\w+)(?:\s+(primary|partition)\s+key)?$", re.IGNORECASE)


@dataclass
class Declaration:
    key: str = "rowid"
    key_type: str = "bigint"
    vectors: dict[str, tuple[str, int, str]] = field(default_factory=dict)  # name: (kind, dimension, metric)
    partitions: dict[str, str] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)
    aux: dict[str, str] = field(default_factory=dict)
    chunk_size: int = 1024

    def columns(self) -> dict[str, str]:
        return {self.key: self.key_type} | {n: VECTORS[k] for n, (k, _, _) in self.vectors.items()} | self.partitions | self.metadata | self.aux


def declare(text: str) -> Declaration:
    out = Declaration()
    for part in (x.strip() for x in text.split(",")):
        if m := re.match(r"chunk_size\s*=\s*(\d+)$", part, re.IGNORECASE):
            out.chunk_size = int(m[1])
            if out.chunk_size % 8 or not 0 < out.chunk_size <= MAX_CHUNK:
                raise ValueError(f"chunk_size must be a multiple of 8 up to {MAX_CHUNK}")
        elif m := _VECTOR.match(part):
            kind, dim, metric = m[2].lower(), int(m[3]), (m[4] or "").lower()
            if not 0 < dim <= MAX_DIM or (kind == "bit" and (dim % 8 or metric)):
                raise ValueError(f"bad vector column: {part}")
            metric = "hamming" if kind == "bit" else metric or "l2"
            if metric not in DISTANCES:
                raise ValueError(f"unknown metric {metric}")
            out.vectors[m[1]] = kind, dim, metric
        elif (m := _SCALAR.match(part)) and m[3].lower() in SCALARS:
            kind, role = SCALARS[m[3].lower()], (m[4] or "").lower()
            if role == "primary":
                if kind not in ("bigint", "string"):
                    raise ValueError("a primary key is an integer or text")
                out.key, out.key_type = m[2], kind
            elif role == "partition":
                if kind not in ("bigint", "string"):
                    raise ValueError("a partition key is an integer or text")
                out.partitions[m[2]] = kind
            else:
                (out.aux if m[1] else out.metadata)[m[2]] = kind
        else:
            raise ValueError(f"cannot read {part!r}")
    for what, most in ((out.vectors, MAX_VECTORS), (out.partitions, MAX_PARTITIONS), (out.aux, MAX_AUX), (out.metadata, MAX_METADATA)):
        if len(what) > most:
            raise ValueError(f"more than {most} columns of a kind")
    if not out.vectors:
        raise ValueError("a vector column is needed")
    return out


#: Comparisons that a filter may use, by the type of its column.
ORDERED = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
COMPARISONS = {"bigint": {*ORDERED, "in"}, "string": {*ORDERED, "in"}, "double": set(ORDERED), "boolean": {"=", "!="}}
VALUES = {"bigint": int, "string": str, "double": (int, float), "boolean": bool}


class VectorTable:
    """Rows of a declaration."""

    def where(self, *filters: tuple) -> Column:
        """All of the filters (column, comparison, value) on partition and metadata columns; anything else is an error."""
        out = F.lit(True)
        for name, op, value in filters:
            kind = (self.d.partitions | self.d.metadata).get(name)
            if kind is None:
                raise ValueError(f"{name} is an auxiliary column and cannot be filtered on" if name in self.d.aux else f"no partition or metadata column {name}")
            if op not in COMPARISONS[kind]:
                raise ValueError(f"{name} is {kind} and cannot be compared by {op}")
            values = list(value) if op == "in" else [value]
            if any(not isinstance(v, VALUES[kind]) or isinstance(v, bool) != (kind == "boolean") for v in values):
                raise ValueError(f"{name} is {kind} and cannot be compared with {value!r}")
            out = out & (F.col(name).isin(values) if op == "in" else getattr(F.col(name), ORDERED[op])(F.lit(value)))
        return out

    def __init__(self, spark: SparkSession, declaration: Declaration | str, rows: DataFrame | None = None):
        self.d = declare(declaration) if isinstance(declaration, str) else declaration
        schema = ", ".join(f"{n} {t}" for n, t in self.d.columns().items())
        self.spark, self.rows = spark, spark.createDataFrame([], schema) if rows is None else rows

    def _checked(self, df: DataFrame) -> DataFrame:
        out = df.select(*(F.col(n).cast(t).alias(n) for n, t in self.d.columns().items()))
        for n, (kind, dim, _) in self.d.vectors.items():
            size = dim // 8 if kind == "bit" else dim
            message = F.concat(F.lit(f"{n} needs {dim} dimensions, got "), F.coalesce(F.size(n).cast("string"), F.lit("null")))
            out = out.withColumn(n, F.when(F.size(n) == size, F.col(n)).otherwise(F.raise_error(message).cast(VECTORS[kind])))
        return out

    def insert(self, df: DataFrame) -> VectorTable:
        """New rows; a key that is there already is an error."""
        if not df.join(self.rows, self.d.key, "left_semi").isEmpty():
            raise ValueError("a key exists already")
        return VectorTable(self.spark, self.d, self.rows.unionByName(self._checked(df)))

    def delete(self, where: Column) -> VectorTable:
        return VectorTable(self.spark, self.d, self.rows.filter(~F.coalesce(where, F.lit(False))))

    def update(self, where: Column, **values: Column) -> VectorTable:
        """Vectors, metadata and auxiliary columns may change; keys and partitions may not."""
        if fixed := {self.d.key, *self.d.partitions} & set(values):
            raise ValueError(f"{sorted(fixed)} cannot be updated")
        hit = F.coalesce(where, F.lit(False))
        changed = self.rows.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in self.rows.columns))
        return VectorTable(self.spark, self.d, self._checked(changed))

    def point(self, key) -> DataFrame:
        return self.rows.filter(F.col(self.d.key) == key)

    def scan(self) -> DataFrame:
        return self.rows

    def knn(self, column: str, query: list, k: int, where: Column | None = None, keys: list | None = None) -> DataFrame:
        """The k rows nearest to the query among those that the filter on partition and metadata columns and the keys admit."""
        kind, dim, metric = self.d.vectors[column]
        if not 0 <= k <= MAX_K:
            raise ValueError(f"k must be 0 to {MAX_K}")
        if len(query) != (dim // 8 if kind == "bit" else dim):
            raise ValueError(f"{column} has {dim} dimensions")
        rows = self.rows if where is None else self.rows.filter(where)
        rows = rows if keys is None else rows.filter(F.col(self.d.key).isin(keys))
        q = F.array(*(F.lit(x) for x in query)).cast(VECTORS[kind])
        return top(rows.withColumn("distance", DISTANCES[metric](F.col(column), q)), k, self.d.key, by="distance", ascending=True)

    def write(self, path: str) -> None:
        """Partition keys become folders, so a filter on them prunes files."""
        w = self.rows.write.mode("overwrite")
        (w.partitionBy(*self.d.partitions) if self.d.partitions else w).parquet(path)
