"""Text analysis as columns: folding, tokens, identifiers, stems, hashes, paths.

What Catalyst can express is built in; stems, NFC and FNV-1a go through Arrow batches with a bounded cache.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..session import by_pieces, map_arrow, pieces
from .stemming import stem

TOKEN = "[\\p{L}\\p{Nd}]+"
IDENT = "[\\p{L}\\p{Nd}_-]+"
COMPOUND = "[_-]|[^\\p{Lu}]\\p{Lu}|\\p{Lu}\\p{Lu}\\p{Ll}"  # what any identifier of two words holds


def fold(s: Column) -> Column:
    """Lower case, ё as е."""
    return F.replace(F.lower(s), F.lit("ё"), F.lit("е"))


def tokens(s: Column) -> Column:
    """Folded maximal runs of letters and decimal digits."""
    return F.regexp_extract_all(fold(s), F.lit(TOKEN), F.lit(0))


def split_ident(word: Column) -> Column:
    """The folded words of one identifier: cut at _ and -, before a capital after a small letter, and before the last capital of a run that a small letter follows."""
    cut = F.regexp_replace(F.regexp_replace(word, "(?<=\\p{Lu})(?=\\p{Lu}\\p{Ll})", "_"), "(?<=[^\\p{Lu}_-])(?=\\p{Lu})", "_")
    return F.transform(F.filter(F.split(cut, "[_-]+"), lambda x: x != ""), fold)


def idents(s: Column) -> Column:
    """Of each identifier of two words or more: its words and then the words joined; not stemmed."""
    runs = F.filter(F.regexp_extract_all(s, F.lit(IDENT), F.lit(0)), lambda x: F.regexp_like(x, F.lit(COMPOUND)))
    parts = F.filter(F.transform(runs, split_ident), lambda p: F.size(p) > 1)
    return F.flatten(F.transform(parts, lambda p: F.concat(p, F.array(F.array_join(p, "")))))


def strip_latin(token: str) -> str:
    """A token without the combining marks of its ASCII-based letters; others, й too, stay."""
    if token.isascii():
        return token
    out = []
    for c in token:
        d = unicodedata.normalize("NFD", c)
        out.append(d[0] if d[0].isascii() else c)
    return "".join(out)


@lru_cache(maxsize=1 << 18)
def stripped_stem(token: str) -> str:
    """A folded token's stem without Latin diacritics; the only cache of a worker that stems columns."""
    return strip_latin(stem.__wrapped__(token))


def stem_lists(t: pa.Array) -> pa.Array:
    """Stems of arrays of tokens; they are encoded as a dictionary, so each distinct token is stemmed once."""
    offsets = t.offsets
    first, last = offsets[0].as_py(), offsets[-1].as_py()
    coded = t.values.slice(first, last - first).dictionary_encode()
    words = pa.array([None if w is None else stripped_stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(pc.subtract(offsets, first), words.take(coded.indices), mask=t.is_null())


@arrow_udf(ArrayType(StringType()))
def stems(t: pa.Array) -> pa.Array:
    """Stems of arrays of folded tokens, Latin diacritics stripped after stemming; order and count stay."""
    return by_pieces(stem_lists)(t)


def stemmed(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with stems() of columns of token arrays, piece by piece: no worker holds the stems of a whole batch."""
    schema = StructType([StructField(f.name, ArrayType(StringType())) if f.name in columns else f for f in rows.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, 1 << 23)):
            yield pa.RecordBatch.from_arrays([stem_lists(c) if n in columns else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    return map_arrow(rows, run, schema)


def stem_text(s: str) -> str:
    """Stems of a text, joined by spaces."""
    return " ".join(stem(t) for t in py_tokens(py_fold(s)))


def py_fold(s: str) -> str:
    return s.lower().replace("ё", "е")


def py_tokens(s: str) -> list[str]:
    """The same runs as TOKEN, on the driver and in workers."""
    import regex

    return regex.findall(r"[\p{L}\p{Nd}]+", s)


def py_idents(s: str) -> str:
    """Stems of the words of identifiers and of the joined words, joined by spaces."""
    import regex

    out: list[str] = []
    for run in regex.findall(r"[\p{L}\p{Nd}_-]+", s):
        cut = regex.sub(r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=[^\p{Lu}_-])(?=\p{Lu})", "_", run)
        parts = [py_fold(p) for p in regex.split(r"[_-]+", cut) if p]
        if len(parts) > 1:
            out += [stem(p) for p in parts] + [stem("".join(parts))]
    return " ".join(out)


@arrow_udf(StringType())
def nfc(s: pa.Array) -> pa.Array:
    return by_pieces(lambda x: pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in x.to_pylist()], pa.string()))(s)


FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3  # fixed values


def fnv1a64_text(data: bytes) -> str:
    """FNV-1a, 64 bits, lower-case hexadecimal without leading zeros."""
    h = FNV_START
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return f"{h:x}"


def fnv1a64_all(texts: pa.Array) -> list[str | None]:
    """The hash of each text, one byte of all of them at a time: longest first, so that those with bytes left are in front."""
    raw = texts.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if len(raw) and raw.buffers()[2] else np.empty(0, np.uint8)
    size = np.diff(offsets)
    by = np.argsort(-size, kind="stable")
    start, left, h = offsets[:-1][by], size[by], np.full(len(size), FNV_START, np.uint64)
    at, live = 0, int((left > 0).sum())
    while live > 8:
        h[:live] = (h[:live] ^ data[start[:live] + at]) * np.uint64(FNV_PRIME)
        at += 1
        live = int(np.searchsorted(-left[:live], -at, side="left"))
    for i in range(live):  # a few very long ones
        x = int(h[i])
        for b in data[start[i] + at : start[i] + left[i]].tolist():
            x = ((x ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
        h[i] = x
    out: list[str | None] = [None] * len(size)
    for i, x in zip(by.tolist(), h.tolist(), strict=True):
        out[i] = f"{x:x}"
    return [o if ok else None for o, ok in zip(out, raw.is_valid().to_pylist(), strict=True)]


@arrow_udf(StringType())
def fnv1a64(s: pa.Array) -> pa.Array:
    return pa.array(fnv1a64_all(s), pa.string())


def human_size(n: Column) -> Column:
    """Bytes with one decimal in units of 1024."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        last = unit == "TB"
        text = F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1024**i)), 1))
        out = out.otherwise(text) if last else out.when(n < 1024 ** (i + 1), text)
    return out


def extension(path: Column) -> Column:
    """The last extension in lower case with its dot, or empty."""
    return F.lower(F.regexp_extract(path, "(\\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(path: Column) -> Column:
    """The path and every folder above it, the longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(2), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def split_list(s: Column) -> Column:
    """A comma list: trimmed, empties dropped."""
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")
