"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Words are lower-cased (A-Z) runs of non-space; an item's set is its distinct shingles of `width` words (an item of
fewer words is one shingle of all its words and is looked for at that width). Items are partitioned by the sizes of
their sets, in powers of two. A partition's sketch takes of each set the m shingles with the smallest hashes, where m
is one more than the shingles that a match may lack in the partition: by the pigeonhole principle a document that
contains at least `threshold` of an item holds one of its m sketch shingles, so nothing is missed however long the
document is. A document's own shingles are looked up in the sketches as it is read; an item that is hit is then held
against the document shingle by shingle.

The items go to every task, in blocks of at most `block` characters and one pass over the documents for each block,
so what is broadcast is bounded whatever the size of the item table.

Edge cases: items without words match nothing; null texts are empty; repeated items or documents give repeated rows;
null ids are carried, and ids may have any type; empty tables give no rows. contained() reads ids and texts only;
decontaminated() keeps all columns of the documents, whatever their names. A very long text is read whole; the cache of
words is bounded in bytes. Ties do not arise: every item that a document contains counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Known, cut, map_arrow, texts

BLOCK_CHARS = 4_000_000
CACHE_WORDS = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


class Hashes:
    """Hashes of words (cached, bounded) and of shingles, all of a text at once."""

    def __init__(self):
        self.cache = Known(CACHE_WORDS)

    def words(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        return np.array(self.cache.of(words, lambda new: (xxh64_intdigest(w, 7) for w in new)), np.uint64)

    @staticmethod
    def shingles(h: np.ndarray, width: int) -> np.ndarray:
        n = len(h) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = h[:n].copy()
        for j in range(1, width):
            out *= _BASE
            out += h[j : j + n]
        return out ^ (out >> np.uint64(29))


class Sketches:
    """The items of one block, ready for look-up."""

    def __init__(self, items: list[bytes], width: int, threshold: float):
        self.hashes, self.sets, anchors = Hashes(), [], {}
        for i, text in enumerate(items):
            words = text.lower().split()
            w = min(width, len(words))
            own = sorted(shingles(words, w)) if w else []
            self.sets.append((w, own))
            if not own:
                continue
            top = 1 << (len(own) - 1).bit_length()  # the largest size in this item's partition
            m = top - int(np.ceil(threshold * top - 1e-9)) + 1
            of = {int(self.hashes.shingles(self.hashes.words(s.split(b" ")), w)[0]) for s in own}
            for x in sorted(of)[:m]:
                anchors.setdefault((w, x), []).append(i)
        self.anchors, self.tables = anchors, {}
        for w in {w for w, _ in anchors}:
            mine = np.array(sorted(x for v, x in anchors if v == w), np.uint64)
            bits = max(16, (64 * len(mine)).bit_length())
            filter_ = np.zeros(1 << bits, bool)
            filter_[mine & np.uint64((1 << bits) - 1)] = True
            self.tables[w] = (mine, filter_, np.uint64((1 << bits) - 1))

    def found(self, text: bytes, threshold: float) -> list[tuple[int, int, int]]:
        """(item, shingles of the item, those in the text) of each item that the text contains."""
        words = text.lower().split()
        if not words:
            return []
        h, out = self.hashes.words(words), []
        for w, (mine, filter_, mask) in self.tables.items():
            s = self.hashes.shingles(h, w)
            s = s[filter_[s & mask]]
            if not len(s):
                continue
            s = np.unique(s)
            s = s[mine[np.minimum(np.searchsorted(mine, s), len(mine) - 1)] == s]
            if not len(s):
                continue
            held = shingles(words, w)
            for i in sorted({i for x in s.tolist() for i in self.anchors[w, x]}):
                own = self.sets[i][1]
                n = sum(x in held for x in own)
                if n >= threshold * len(own) - 1e-9:
                    out.append((i, len(own), n))
        return out


def blocks(items: DataFrame, size: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items (item_id, text) in bounded blocks; only one block at a time is on the driver."""
    held, chars = [], 0
    for row in items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        text = row["text"].encode()
        if held and chars + len(text) > size:
            yield held
            held, chars = [], 0
        held.append((row["item_id"], text))
        chars += len(text)
    if held:
        yield held


def contained(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, block: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found: each pair whose document holds at least threshold of the item's shingles."""
    kinds = [docs.schema["doc_id"].dataType, items.schema["item_id"].dataType]
    schema, out = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, n_shingles bigint, n_found bigint", None
    ids = to_arrow_type(kinds[1])
    for part in blocks(items, block):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sketches = Sketches([t for _, t in shared.value], width, threshold)
            for batch in batches:
                rows = [(k, *x) for k, t in enumerate(texts(batch)) for x in sketches.found(t, threshold)]
                at = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([at, pa.array([shared.value[r[1]][0] for r in rows], ids), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], ["doc_id", "item_id", "n_shingles", "n_found"])

        got = map_arrow(docs.select("doc_id", "text"), run, schema)
        out = got if out is None else out.unionByName(got)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, block: int = BLOCK_CHARS) -> DataFrame:
    """docs, all columns, without the documents that contain an item; one pass over the documents for each block."""
    out, first = docs, True
    for part in blocks(items, block):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sketches = Sketches([t for _, t in shared.value], width, threshold)
            for batch in batches:
                yield batch.filter(pa.array([not sketches.found(t, threshold) for t in texts(batch)], pa.bool_()))

        if not first:
            out = cut(out)
        out, first = map_arrow(out, run, docs.schema), False
    return out
