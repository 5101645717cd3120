"""Paths to texts: read, decode or extract, hash. One Arrow pass; a file that fails is a row with a code."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import fnv1a64_text
from ..session import map_arrow
from . import formats
from .decode import decode

READ = "path string, size bigint, mtime bigint, text string, hash string, code string, message string"


def read_one(path: str, max_size: int) -> tuple[str | None, str | None, str | None]:
    """(text, code, message): code is null for a text, else why there is none."""
    try:
        with open(path, "rb") as f:
            data = f.read(max_size + 1)
    except FileNotFoundError as e:
        return None, "vanished", str(e)
    except OSError as e:
        return None, "read_failed", str(e)
    if not data or len(data) > max_size:
        return None, "too_large" if data else "empty", None
    if formats.supports(path):
        try:
            text = unicodedata.normalize("NFC", formats.extract(path, data))
        except Exception as e:  # noqa: BLE001  whatever a broken file makes a parser raise
            return None, "extract_failed", f"{type(e).__name__}: {e}"
        return (text, None, None) if text.strip() else (None, "empty", None)
    got = decode(data)
    return (got[0], None, None) if got else (None, "binary", None)


def read(files: DataFrame, max_size: int) -> DataFrame:
    """files (path, size, mtime) with text and hash, or a code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_one(p, max_size) for p in batch.column("path").to_pylist()]
            hashes = [None if t is None else fnv1a64_text(t.encode()) for t, _, _ in rows]
            text, code, message = (pa.array([r[i] for r in rows], pa.string()) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size"), batch.column("mtime"), text, pa.array(hashes, pa.string()), code, message], ["path", "size", "mtime", "text", "hash", "code", "message"])

    return map_arrow(files.select("path", "size", "mtime"), run, READ)
