"""Embeddings: any function from texts to vectors; an HTTP client with retries, and a deterministic one for tests."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import arrow_filesystem, map_arrow, pieces

BATCH = 32
Embedder = Callable[[list[str]], list[list[float]]]


class EmbedError(RuntimeError):
    code = "embed_failed"


class HttpEmbedder:
    """POST {model, input[]} to /api/embed; network errors and 5xx are tried again with doubled waits, 4xx are not."""

    def __init__(self, url: str, model: str, attempts: int = 3, timeout: float = 120.0, wait: float = 1.0):
        self.url, self.model, self.attempts, self.timeout, self.wait = url.rstrip("/"), model, attempts, timeout, wait

    def __call__(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(self.url + "/api/embed", body, {"Content-Type": "application/json"})
        for k in range(self.attempts):
            if k:
                time.sleep(self.wait * 2 ** (k - 1))
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    got = json.load(r)["embeddings"]
                break
            except urllib.error.HTTPError as e:
                if e.code < 500 or k + 1 == self.attempts:
                    raise EmbedError(f"embedding server answered {e.code}") from e
            except OSError as e:
                if k + 1 == self.attempts:
                    raise EmbedError(str(e)) from e
        if len(got) != len(texts):
            raise EmbedError(f"{len(texts)} texts gave {len(got)} vectors")
        return got


def hashed_trigrams(texts: list[str], dim: int = 16) -> list[list[float]]:
    """Signed counts of the character trigrams of lower-case texts, for tests and demonstrations; no model needed.

    A trigram's number is its code points in base 1009 modulo 65,521: its place is the number modulo dim, its sign
    whether the number over dim is even. A text of fewer than three characters is the zero vector.
    """
    out = []
    for t in texts:
        c = np.array([ord(x) for x in t.lower()], np.int64)
        h = (c[:-2] * 1009 * 1009 + c[1:-1] * 1009 + c[2:]) % 65_521 if len(c) > 2 else np.empty(0, np.int64)
        out.append(np.bincount(h % dim, 1.0 - 2.0 * (h // dim % 2), dim).tolist())
    return out


def unit(v: list[float]) -> list[float]:
    n = sum(x * x for x in v) ** 0.5
    return v if n < 1e-12 else [x / n for x in v]


def embed(chunks: DataFrame, embedder: Embedder, prefix: str = "", keys: tuple[str, ...] = ("path", "seq"), concurrency: int | None = None) -> DataFrame:
    """keys and embedding (unit length) of chunks with a text, in requests of BATCH texts.

    Partitions run side by side, a request at a time each; concurrency bounds how many partitions there are.
    """
    kinds = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b)):
            texts, out = [prefix + (t or "") for t in batch.column("text").to_pylist()], []
            for k in range(0, len(texts), BATCH):
                out += map(unit, embedder(texts[k : k + BATCH]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.list_(pa.float32()))], [*keys, "embedding"])

    rows = chunks.select(*keys, "text")
    return map_arrow(rows if concurrency is None else rows.coalesce(max(1, concurrency)), run, f"{kinds}, embedding array<float>")


def npy_header(raw: bytes) -> tuple[tuple[int, ...], str, int]:
    """Shape, element type and where the elements start, of the first bytes of a .npy file."""
    import ast

    if raw[:6] != b"\x93NUMPY":
        raise ValueError("no .npy data")
    wide = raw[6] > 1
    size = int.from_bytes(raw[8:12] if wide else raw[8:10], "little")
    at = 12 if wide else 10
    head = ast.literal_eval(raw[at : at + size].decode("latin-1"))
    if head["fortran_order"] or head["descr"] != "<f4" or len(head["shape"]) != 2:
        raise ValueError("a two-dimensional float32 array in C order is needed")
    return head["shape"], head["descr"], at + size


def read_npy(spark, source: str | bytes, block: int = 1 << 16) -> DataFrame:
    """vec_id, embedding of a two-dimensional float32 .npy file (a URI or path that executors can read) or of its bytes.

    Of a file, executors read `block` rows at a time; only its header is read here.
    """
    if isinstance(source, bytes):
        (n, dim), _, at = npy_header(source)
        rows = np.frombuffer(source, "<f4", n * dim, at).reshape(n, dim)
        return spark.createDataFrame(((i, row.tolist()) for i, row in enumerate(rows)), "vec_id bigint, embedding array<float>")
    fs, path = arrow_filesystem(source)
    with fs.open_input_file(path) as f:
        (n, dim), _, at = npy_header(f.read(1 << 16))
    blocks = -(-n // block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = arrow_filesystem(source)
        with fs.open_input_file(path) as f:
            for first in (b * block for batch in batches for b in batch.column("id").to_pylist()):
                count = min(block, n - first)
                f.seek(at + 4 * dim * first)
                data = np.frombuffer(f.read(4 * dim * count), "<f4")
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, dim * count + 1, dim, dtype=np.int32)) if dim else pa.array(np.zeros(count + 1, np.int32)), pa.array(data))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + count)), values], ["vec_id", "embedding"])

    return map_arrow(spark.range(0, blocks, 1, max(1, min(blocks, 10_000))), run, "vec_id bigint, embedding array<float>")


def read_blob(spark, data: bytes, dim: int) -> DataFrame:
    """vec_id, embedding of a static table of float32 vectors that lie end to end in bytes."""
    if dim < 1 or len(data) % (4 * dim):
        raise ValueError(f"{len(data)} bytes are no whole number of vectors of {dim} elements")
    rows = np.frombuffer(data, "<f4").reshape(-1, dim)
    return spark.createDataFrame(((i, row.tolist()) for i, row in enumerate(rows)), "vec_id bigint, embedding array<float>")
