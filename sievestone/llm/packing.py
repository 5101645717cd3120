"""Best-fit packing of tokenised documents into sequences of bounded size.

Pieces come from one Arrow pass over the texts; white space always ends a token of the word-end BPE, so ids are cached
by white-space-delimited word. Arrow numbers the distinct words of a block of texts and joins the ids of all of its
words, so that Python looks up each distinct word once a block. The cache is dropped when its worker leaves the stage.

Packing is vector best-fit decreasing. A sequence has three capacities (tokens, documents, attention cost = sum of
squared piece lengths); an item goes where every residual admits it and the weighted residual norm after placing is
least (or the weighted dot product of item and residual is largest). Pieces are dealt evenly, whatever their values,
to groups of `group` pieces that are packed apart. The sequences that a group leaves poorly filled, the least filled
first and up to half of its pieces, are gathered and packed again with those of other groups, round after round until
what is left is one group. So each group but the last hands its remainders on, and more groups cost no sequences.

Edge cases: a null or empty text has the end id alone, one piece of length 1. Repeated rows are packed as often as
they occur. Null ids are carried; ids may have any type that sorts. Ties go by id, piece and checksum. An empty table
gives no rows. pieces() reads the id and text columns only; pack() carries all columns but replaces any that are called
sequence_id or offset. A very long text is encoded whole; the caches of words are bounded in entries and in bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import cut, held, map_arrow, texts, unused

#: Words, and parts of words, that a worker keeps for each generation: some 0.7 kB of memory each, against work done twice;
#: bytes of them; bytes of texts that are cut at once with that many words (fewer with fewer); parts that are encoded at once.
CACHE, CACHE_BYTES, BLOCK, LOT = 500_000, 48 << 20, 8 << 20, 4096
#: The tokenizer's own cut of a word. Parts are cut here only for words of Latin letters, where it is sure to be the same.
PLAIN = re.compile("^([a-zªµºß-öø-ɏ]+)([.,]?)$|^.*$", re.M)  # of lines in lower case: letters and a stop or comma, or anything else
PARTS = "'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+"
#: Of tokens, documents and attention cost in the residual norm.
WEIGHTS = (1.0, 0.25, 0.25)


class Recent:
    """A bounded cache in two generations: what was used since the last turn outlives it."""

    def __init__(self, most: int):
        self.most, self.now, self.old, self.bytes = most, {}, {}, 0

    def lacking(self, keys: set) -> set:
        """The keys that neither generation has; those of the old one are taken over."""
        if len(self.now) > self.most or self.bytes > CACHE_BYTES:
            self.old, self.now, self.bytes = self.now, {}, 0
        out = keys.difference(self.now)  # plain dicts: compared without a Python loop
        new = out.difference(self.old)
        if len(new) < len(out):
            self.now.update((k, self.old[k]) for k in out - new)
        self.bytes += sum(map(len, out))
        return new


class WordIds:
    """Bytes of texts' ids (little-endian, 4 each), by bounded caches of words and of their parts."""

    def __init__(self, path: str, cache: int = CACHE):
        import regex
        from tokenizers import Tokenizer

        self.tok, self.words, self.parts, self.cut = Tokenizer.from_file(path), Recent(cache), Recent(cache), regex.compile(PARTS)
        self.size = max(1 << 20, BLOCK * cache // CACHE)
        ends = {i for w, i in self.tok.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")}
        self.ends = np.array([i in ends for i in range(self.tok.get_vocab_size())])
        with open(path) as f:
            self.known_cut = "|[\\\\p{L}]+|[\\\\p{N}]|" in f.read(4000) and bool(ends)

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text; at most self.size bytes of texts at once, or one text."""
        at = 0
        while at < len(texts):
            first, size = at, 0
            while at < len(texts) and size < self.size:
                size, at = size + len(texts[at]), at + 1
            yield from self.block(texts[first:at])

    def block(self, texts: list[bytes]) -> Iterator[bytes]:
        """Words are cut, numbered and replaced by their ids in Arrow; Python sees each distinct word once."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))  # of the bytes that bytes.split() cuts at
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        self.learn(self.words.lacking(set(distinct) - {b""}))
        known = self.words.now
        known[b""] = b""  # Arrow's word before leading and after trailing white space
        ids = pa.array(list(map(known.__getitem__, distinct)), pa.large_binary()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[lists.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return (bytes(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False))

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def cut_word(self, s: str) -> list[str] | None:
        """The parts of a word in lower case, or None where only the tokenizer knows them."""
        if not (s.isascii() or max(s) < "\u0250" and "\u0130" not in s) or not self.known_cut or len(s) > 1000:
            return None
        if s.isalpha():
            return [s.lower()]
        if s[-1] in ".," and s[:-1].isalpha():
            return [s[:-1].lower(), s[-1]]
        return None if "<|" in s else self.cut.findall(s.lower())

    def learn(self, words: set[bytes]) -> None:
        lines, other, out = list(words), [], self.words.now
        cuts = PLAIN.findall(b"\n".join(lines).decode("utf-8", "replace").lower()) if lines and self.known_cut else [("", "")] * len(lines)
        odd = []  # words that aren't plain, cut one by one or encoded whole
        for w in [w for w, (a, _) in zip(lines, cuts, strict=True) if not a]:
            s = w.decode("utf-8", "replace")
            parts = self.cut_word(s)
            if parts is None:
                other.append((w, s))
            else:
                odd.append((w, parts))
        wanted = {a for a, _ in cuts}
        wanted.update((".", ","), *(ps for _, ps in odd))
        wanted.discard("")
        new = list(self.parts.lacking(wanted))
        if new:  # all at once: each part is one word of the model, and a word's last piece says that it is the last
            lots = [" ".join(new[i : i + LOT]) for i in range(0, len(new), LOT)]
            ids = np.concatenate([np.array(self.tok.encode_batch_fast([x], add_special_tokens=False)[0].ids, "<u4") for x in lots])
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(new):
                raw, bounds = ids.tobytes(), (4 * at).tolist()
                self.parts.now.update(zip(new, map(raw.__getitem__, map(slice, [0, *bounds], bounds)), strict=False))
            else:
                self.parts.now.update(zip(new, self.encoded(new), strict=True))
        of = self.parts.now
        stop = {"": b"", ".": of["."], ",": of[","]}
        out.update((w, of[a] + stop[b]) for w, (a, b) in zip(lines, cuts, strict=True) if a)
        out.update((w, b"".join(map(of.__getitem__, ps))) for w, ps in odd)
        out.update(zip([w for w, _ in other], self.encoded([s for _, s in other]), strict=True))


def encoder(path: str, cache: int) -> WordIds:
    """One encoder for each worker process and stage."""
    import gc
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    gc.set_threshold(200_000)  # lists of words are many and form no cycles
    return held((path, cache), lambda: WordIds(path, cache))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and end_id, cut into capacity ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cache)
        for batch in batches:
            at, piece, length, crc, ids = [], [], [], [], []
            for i, found in enumerate(encode(texts(batch))):
                raw = memoryview(found + end)
                for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[a : a + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            k = np.array(piece, np.int64)
            cols = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(k * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float], select: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset there of each item; items must come in descending order of length."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    cap = np.array([capacity, max_docs, max_cost], np.float64)
    w0, w1, w2 = weights
    tokens, docs, cost, ids = (np.zeros(n, np.int64) for _ in range(4))  # residuals and numbers of the open bins
    live, made, least = 0, 0, int(lengths[-1]) if n else 0
    for i in range(n):
        x = int(lengths[i])
        best = -1
        if live:
            t, d, c = tokens[:live] - x, docs[:live] - 1, cost[:live] - x * x
            ok = (t >= 0) & (d >= 0) & (c >= 0)
            if select == "norm":
                score = w0 * np.square(t / cap[0]) + w1 * np.square(d / cap[1]) + w2 * np.square(c / cap[2])
            else:
                score = -(w0 * tokens[:live] * (x / cap[0] ** 2) + w1 * docs[:live] / cap[1] ** 2 + w2 * cost[:live] * (x * x / cap[2] ** 2))
            score[~ok] = np.inf
            best = int(score.argmin())
            if not ok[best]:
                best = -1
        if best < 0:
            if x > capacity or x * x > max_cost or max_docs < 1:
                raise ValueError(f"an item of {x} tokens fits no empty sequence")
            best, live = live, live + 1
            tokens[best], docs[best], cost[best], ids[best] = capacity, max_docs, max_cost, made
            made += 1
        bins[i], offsets[i] = ids[best], capacity - tokens[best]
        tokens[best] -= x
        docs[best] -= 1
        cost[best] -= x * x
        if tokens[best] < least or not docs[best] or cost[best] < least * least:  # nothing that is left fits
            live -= 1
            for a in (tokens, docs, cost, ids):
                a[best] = a[live]
    return bins, offsets


def _packed(rows: DataFrame, size: int, group: int, level: int, poor: float, args: tuple) -> DataFrame:
    """One round over checkpointed rows: dealt evenly to groups, each packed on its own; __again: to be packed again."""
    names, capacity = rows.columns, args[0]
    groups = max(1, -(-size // group))
    g, again = unused(rows, "__g", "__again")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = t["length"].to_numpy()
        bins, offsets = best_fit(length, *args)
        fill, count = np.bincount(bins, length) / capacity, np.bincount(bins)
        by = np.argsort(fill, kind="stable")
        left = np.zeros(len(fill), bool)
        left[by] = (fill[by] < poor) & (np.cumsum(count[by]) <= max(len(t) // 2, count[by[0]])) & (groups > 1)
        first = (level << 58) + (t[g][0].as_py() << 24)
        return pa.table([*(t[c] for c in names), pa.array(first + bins), pa.array(offsets), pa.array(left[bins])], names=[*names, "sequence_id", "offset", again])

    schema = StructType([*rows.schema, StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField(again, BooleanType())])
    dealt = rows.withColumn(g, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(groups)))
    return dealt.groupBy(g).applyInArrow(run, schema).withColumnRenamed(again, "__again")


def pack(rows: DataFrame, capacity: int = 4096, max_docs: int = 4096, max_cost: int = 4096 * 4096, weights: tuple[float, float, float] = WEIGHTS, select: str = "norm", group: int = 8192, poor: float = 0.995) -> DataFrame:
    """rows (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset.

    Sequences filled under `poor` are packed again, at most half of a round's pieces, so rounds shrink and end.
    """
    rows = cut(rows.drop("sequence_id", "offset"))
    size, done, level, args = rows.count(), [], 0, (capacity, max_docs, max_cost, weights, select)
    while size > group:
        got = cut(_packed(rows, size, group, level, poor, args))
        done.append(got.filter(~F.col("__again")).drop("__again"))
        rows = cut(got.filter("__again").select(*rows.columns))
        before, size, level = size, rows.count(), level + 1
        if size >= before:  # one sequence a group and nothing to gain
            break
    out = _packed(rows, 1, group, level, poor, args).drop("__again") if size <= group else _packed(rows, size, group, level, poor, args).drop("__again")
    for x in done:
        out = out.unionByName(x)
    return out
