"""SimHash near-duplicate detection by pigeonhole blocks.

A 64-bit fingerprint is cut into m blocks. Two fingerprints that differ in at most k bits agree on at least m - k
blocks, so each choice of m - k blocks makes a key and close pairs share one of the keys; m grows with the number of
fingerprints so that chance meetings stay few. Distinct fingerprints, not documents, are keyed. Keys are counted first:
rows of a key that many share get finer keys before they are grouped, made of the key and one of k + 1 blocks of its
other bits, which close pairs still share; a finer key that many share still is cut into tiles of bounded size, each
compared on its own. A group gives the edges of a spanning forest of the verified links, never all pairs, and the
components of these edges are those of all links.

Edge cases: null and empty texts have fingerprint zero and are linked as any other. Rows with a null doc_id take the
smallest non-null doc_id of their component, or null. Repeated rows stay in near_duplicates(); representatives() keeps
one row of each component, ties by the place that it was read at. Extra columns may have any name. Very long texts are
hashed in steps of bounded size. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, map_arrow, noted, scratch, texts, with_group
from .components import components

TILE = 4096


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The majority of the bits of the XXH64 of all shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    line, step = b" ".join(words), 1 << 16
    if len(words) <= width:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for i in range(0, len(a), step):
        h = np.array([xxh64_intdigest(line[x:y], seed) for x, y in zip(a[i : i + step], b[i : i + step], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > len(a), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), part and place (where the row was read)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            fp = np.array([fingerprint(t, width) for t in texts(batch)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp), pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n))], ["doc_id", "fp", "part", "place"])
            at += n

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp bigint, part bigint, place bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(bits: list[int], m: int) -> list[int]:
    """Masks of m blocks of the given bits, as even as can be."""
    at = [len(bits) * i // m for i in range(m + 1)]
    return [sum(1 << b for b in bits[at[i] : at[i + 1]]) for i in range(m)]


def masks(count: int, radius: int, meet: int = 256) -> list[int]:
    """The key masks for so many fingerprints: the fewest blocks for which a key meets at most `meet` others by chance."""
    m = next(m for m in range(radius + 1, 64) if count <= meet << (64 * (m - radius) // m) or m == radius + 4)
    return [sum(x) for x in combinations(_blocks(list(range(64)), m), m - radius)]


def finer(mask: int, radius: int) -> list[int]:
    """The mask with one of radius + 1 blocks of its other bits."""
    return [mask | x for x in _blocks([b for b in range(64) if not mask >> b & 1], radius + 1)]


class Forest:
    """Union-find over fingerprints; join() says whether a link is news."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of differing bits of longs (bitwise_count takes the absolute value of signed ones)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest_edges(fp: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect whatever links of at most radius bits connect: a breadth-first search over the rest."""
    rest = np.unique(fp)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = differing(rest, x) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                queue.extend(found)
                yield from ((int(x), int(y)) for y in found)


def near_pairs(fp: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect whatever links of at most radius bits connect; small groups are compared at once."""
    if len(fp) > 1024:
        yield from forest_edges(fp, radius)
        return
    a, b = np.nonzero(differing(fp[:, None], fp[None, :]) <= radius)
    later = a < b
    if later.sum() > 8 * len(fp):
        yield from forest_edges(fp, radius)
    else:
        yield from zip(fp[a[later]].tolist(), fp[b[later]].tolist(), strict=True)


def _keyed(fps: DataFrame, key_masks: list[int], radius: int, hot: int, tile: int) -> DataFrame:
    """fp and k, the key of a group: keys over `hot` rows are made finer, finer ones over `tile` are cut into tiles."""
    key = lambda i, j, mask: F.xxhash64(F.lit(i), F.lit(j), F.col("fp").bitwiseAND(F.lit(_signed(mask))))
    first = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), key(i, -1, x).alias("k")) for i, x in enumerate(key_masks))))
    keyed = fps.select("fp", first.alias("x")).select("fp", "x.i", "x.k")
    many = cut(keyed.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("k", "n"))
    if many.isEmpty():
        return keyed.select("fp", "k")
    split = F.pmod(F.xxhash64("fp"), F.lit(64)).cast("int")  # a hot key's rows meet its note in 64 places
    noted_keys = many.select("k", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("split"), F.lit(True).alias("many"))
    marked = cut(keyed.withColumn("split", split).join(noted_keys, ["k", "split"], "left").select("fp", "i", "k", "many"))
    plain = marked.filter("many is null").select("fp", "k")
    by_mask = F.array(*(F.array(*(key(i, j, y) for j, y in enumerate(finer(x, radius)))) for i, x in enumerate(key_masks)))
    fine = marked.filter("many").select("fp", F.explode(F.get(by_mask, F.col("i"))).alias("k"))
    large = cut(fine.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("k", F.ceil(F.col("n") / tile).alias("parts")))
    if large.isEmpty():
        return plain.unionByName(fine)
    noted_keys = large.select("k", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("split"), "parts")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts"))
    tiles = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda x: F.xxhash64("k", F.least(x, mine), F.greatest(x, mine)))
    found = fine.withColumn("split", split).join(noted_keys, ["k", "split"], "left")
    return plain.unionByName(found.select("fp", F.explode(F.when(F.col("parts").isNull(), F.array("k")).otherwise(tiles)).alias("k")))


def links(fps: DataFrame, count: int, radius: int = 4, tile: int = TILE, hot: int = 4 * TILE) -> DataFrame:
    """Distinct fingerprints (fp) to edges (u, v) of a forest with the components of all links of at most radius bits."""
    groups = _keyed(fps, masks(count, radius), radius, hot, tile).repartition("k").sortWithinPartitions("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held_k, held_fp = Forest(), np.empty(0, np.int64), np.empty(0, np.int64)

        def edges(k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(np.diff(k)) + 1
            starts, sizes = np.concatenate(([0], at)), np.diff(np.concatenate(([0], at, [len(k)])))
            out = []
            two = starts[sizes == 2]  # pairs: all at once
            near = differing(fp[two], fp[two + 1]) <= radius
            out += [(a, b) for a, b in zip(fp[two[near]].tolist(), fp[two[near] + 1].tolist(), strict=True) if known.join(a, b)]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                out += [(a, b) for a, b in near_pairs(fp[s : s + n], radius) if known.join(a, b)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])

        for batch in batches:
            k = np.concatenate((held_k, batch.column("k").to_numpy()))
            fp = np.concatenate((held_fp, batch.column("fp").to_numpy()))
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))  # the last group may go on in the next batch
            held_k, held_fp = k[last:], fp[last:]
            if last:
                yield edges(k[:last], fp[:last])
        if len(held_k):
            yield edges(held_k, held_fp)

    return map_arrow(groups, run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links of at most radius bits) for every document."""
    rows = cut(fingerprints(docs, width).select("doc_id", "fp"))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(fps.select("fp"), fps.count(), radius))
    named = cut(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = cut(named.select("fp", "root", "n").join(least, "root").select("fp", "component_id", "n"))
    return with_group(rows, ids, "fp", rows.count()).select("doc_id", "fp", "component_id")


def hex64(fp):
    """A signed long as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def representatives(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """docs, all columns: of each component the one row with the smallest doc_id (nulls last), the first read of these.

    The rows to keep are found among (id, fingerprint, part, place) rows. Where in which part they stand is written to
    the shared folder by part, and a second scan of docs keeps them: texts are never shuffled and nothing is broadcast.
    A plain scan of files is read in the same parts again; anything else is stored in the shared folder first.
    """
    if not docs._jdf.queryExecution().analyzed().toString().lstrip().startswith("Relation ["):
        docs = cut(docs)
    rows = cut(fingerprints(docs, width))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "part", "place"))
    fps = cut(rows.groupBy("fp").agg(first.alias("first")))
    roots = components(links(fps.select("fp"), fps.count(), radius))
    named = fps.join(roots, fps.fp == roots.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    keep = named.groupBy("root").agg(F.min("first").alias("first")).select("first.part", "first.place", "first.doc_id")
    where = scratch(docs.sparkSession, "kept")
    dealt(keep, "part", where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        notes, at = noted(where, "part", TaskContext.get().partitionId()), 0
        place = np.sort(notes["place"].to_numpy()) if notes is not None else np.empty(0, np.int64)
        ids = notes.sort_by("place")["doc_id"] if notes is not None else None
        for batch in batches:
            a, b = np.searchsorted(place, (at, at + batch.num_rows))
            out = batch.take(pa.array(place[a:b] - at))
            if b > a and not out.column("doc_id").equals(ids.slice(a, b - a).combine_chunks()):
                raise ValueError("the rows stand in other places than when they were first read")
            at += batch.num_rows
            yield out

    return map_arrow(docs, run, docs.schema)
