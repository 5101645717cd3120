"""Bytes to text: binary detection, UTF-8, and Cyrillic single-byte encodings by plausibility."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import map_arrow, pieces

SNIFF = 8192
ENCODINGS = {"windows-1251": "cp1251", "koi8-r": "koi8_r", "ibm866": "cp866"}
LEAST_SCORE, WORDY, LEAST_SPACE = 0.5, 32, 0.02


def plausible(text: str) -> float:
    """How much a decoded text looks like Cyrillic prose, 0 to 1."""
    high = [c for c in text if c >= "\x80"]
    if not high or (len(text) >= WORDY and sum(map(str.isspace, text)) < LEAST_SPACE * len(text)):
        return 0.0
    cyrillic = [c for c in high if "Ѐ" <= c <= "ԯ"]
    lower = sum(map(str.islower, cyrillic)) / len(cyrillic) if cyrillic else 0.0
    return max(0.0, len(cyrillic) / len(high) * (0.3 + 0.7 * lower) - high.count("�") / len(high))


def decode(data: bytes) -> tuple[str, str] | None:
    """(NFC text, encoding), or None for binary data. Of equally plausible encodings the first wins."""
    if b"\x00" in data[:SNIFF]:
        return None
    try:
        return unicodedata.normalize("NFC", data.decode("utf-8")), "utf-8"
    except UnicodeDecodeError:
        tried = [(plausible(t), -i, name, t) for i, (name, codec) in enumerate(ENCODINGS.items()) for t in [data.decode(codec, "replace")]]
    score, _, name, text = max(tried)
    return (unicodedata.normalize("NFC", text), name) if score >= LEAST_SCORE else None


def decode_all(rows: DataFrame, raw: str, *keys: str) -> DataFrame:
    """keys, encoding and text of rows with a column of bytes (null: empty); both null for binary data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b)):
            got = [decode(x or b"") or (None, None) for x in batch.column(raw).to_pylist()]
            texts, encodings = (pa.array([g[i] for g in got], pa.string()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), encodings, texts], [*keys, "encoding", "text"])

    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return map_arrow(rows.select(*keys, raw), run, f"{kinds}encoding string, text string")
