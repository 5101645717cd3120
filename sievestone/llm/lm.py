"""Language-model scoring by cross-entropy difference.

A target model (of texts of the wanted kind) and a background model (of the documents) are bigram models of the same
form: one vocabulary, all words of both corpora together (or, if a `size` is given, the most frequent ones and a
symbol for all others); one smoothing, bigrams interpolated with add-one unigrams; and background counts scaled to the
target's total, so that smoothing weighs the same in both. A document's score is the mean over its tokens of the target
model's loss less the background model's; lower is nearer to the target.

Every bigram and word that occurs is counted, over all texts of both corpora, so the model grows with the input and no
worker holds it whole. Texts are taken in chunks of bounded size. A chunk sends the keys (62-bit hashes) and counts of
its distinct bigrams and words to the buckets that hold ranges of keys; their number grows with the input. A bucket
sums the counts of all chunks and answers each chunk to be scored with the sums of its own keys, in the order they came
in; the chunk's texts go along as word numbers. However common a word is, a chunk sends it once.

Edge cases: null and empty texts have no tokens and a null score. Repeated rows and null ids are kept. Words that
neither corpus has count as seen no time. Other columns are ignored, whatever their names. A very long text is one chunk
of its own. Ties do not arise. Without target texts (or background) that model is uniform. An empty table
gives no rows. Two bigrams with one hash would be counted together (one such pair is expected in three billion).
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, texts

HELD_WORDS = 400_000
CHUNK_TOKENS, CHUNK_DOCS, BUCKET_BYTES = 2_000_000, 200_000, 8 << 20
START, UNKNOWN = b"", b" "  # no word has these bytes
BIGRAM, SECOND, FIRST = 0, 1, 2  # what a key counts: a bigram, a word, a word before another


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents (A-Z in lower case); summed in the tasks that read, in bounded tables, then by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for t in texts(batch):
                held.update(t.lower().split())
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    return map_arrow(docs.select("text"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(texts: DataFrame, size: int) -> list[str]:
    """The `size` most frequent words, ties by the word.

    Only words at least as frequent as a power of two that `size` words reach are sorted, so few more than `size` rows
    come to the driver however many tasks have counted.
    """
    counts = cut(word_counts(texts))
    power = F.floor(F.log2("n")).cast("int")
    reached, least = 0, 0
    for r in sorted(counts.groupBy(power.alias("p")).agg(F.count("*").alias("m")).collect(), key=lambda r: -r["p"]):  # 64 rows at most
        reached, least = reached + r["m"], r["p"]
        if reached >= size:
            break
    return [r["word"] for r in counts.filter(F.col("n") >= 1 << least).orderBy(F.desc("n"), "word").limit(size).collect()]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as compressed bytes, the n-th bytes of all numbers side by side."""
    raw = pickle.dumps([(a.dtype.str, a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in arrays])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))
    size = lambda kind: np.dtype(kind).itemsize
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size(kind), -1).T).view(kind).ravel() for kind, b in raw]


def mixed(a: np.ndarray, kind: int) -> np.ndarray:
    """Well-spread 64-bit keys whose last two bits are the kind."""
    x = a + np.uint64(kind)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x & ~np.uint64(3)) | np.uint64(kind)


def keys_of(words: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's word hashes and its numbered tokens (0 before each text): first and second of all bigrams, and their keys."""
    at = np.flatnonzero(x[1:])
    first, second = x[at], x[at + 1]
    return first, second, mixed(words[first] * np.uint64(0x9E3779B97F4A7C15) + words[second], BIGRAM)


class Numbers(dict):
    """Numbers of words in the order of their first look-up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """Texts of one use (counted as target, as background, to be scored), as word numbers."""

    def __init__(self):
        self.numbers, self.ids, self.tokens, self.size = Numbers({START: 0}), [], [], 0

    def add(self, doc_id, text: bytes, known: set[bytes] | None) -> None:
        words = text.lower().split()
        if known is not None:
            words = [w if w in known else UNKNOWN for w in words]
        self.ids.append(doc_id)
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, [START, *words]), np.uint32, len(words) + 1))
        self.size += len(words)

    def rows(self, chunk: int, use: tuple[bool, bool, bool], buckets: int) -> Iterator[tuple]:
        """part, chunk, data, ids: its keys and counts by bucket; if it is to be scored, its tokens for the part -1 - chunk."""
        words = np.array([int.from_bytes(blake2b(w, digest_size=8).digest(), "little") for w in self.numbers], np.uint64)
        x = np.concatenate(self.tokens)
        first, second, bigrams = keys_of(words, x)
        own = [np.unique(bigrams, return_counts=True)]
        for kind, of in ((SECOND, second), (FIRST, first)):
            n = np.bincount(of, minlength=len(words))
            own.append((mixed(words, kind), n))
        keys, n = (np.concatenate(c) for c in zip(*own, strict=True))
        by = np.argsort(keys)
        keys, n = keys[by], n[by].astype(np.uint32)
        bounds = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
        for k in range(buckets) if use[2] else np.flatnonzero(np.diff(bounds)).tolist():  # every bucket tells its totals
            part = slice(bounds[k], bounds[k + 1])
            yield k, chunk, packed(np.diff(keys[part], prepend=np.uint64(0)), n[part], np.array(use, np.uint8)), None
        if use[2]:
            yield -1 - chunk, chunk, packed(words, x), self.ids


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _sent(docs: DataFrame, vocab: list[str] | None, buckets: int, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    uses, most = ["__target", "__background", "__scored"], CHUNK_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = None if shared.value is None else {w.encode() for w in shared.value}
        held: dict[tuple, Chunk] = {}
        chunk, kind = TaskContext.get().partitionId() << 32, pa.int64()

        def out(use: tuple) -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            for part, c, data, ids in held.pop(use).rows(chunk, use, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([c], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(kind))], ["part", "chunk", "data", "ids"])
            chunk += 1

        for batch in batches:
            kind = batch.column("doc_id").type
            for doc_id, t, *use in zip(batch.column("doc_id").to_pylist(), texts(batch), *(batch.column(c).to_pylist() for c in uses), strict=True):
                own = held.setdefault(tuple(use), Chunk())
                own.add(doc_id, t, known)
                if own.size > most or len(own.ids) > CHUNK_DOCS:
                    yield from out(tuple(use))
        for use in list(held):
            yield from out(use)

    return map_arrow(docs.select("doc_id", "text", *uses), run, schema)


def _answered(t: pa.Table) -> pa.Table:
    """A bucket's sums, for each chunk to be scored in the order of its keys, and its distinct words and totals."""
    if t["part"][0].as_py() < 0:
        return t
    got = [unpacked(x) for x in t["data"].to_pylist()]
    keys = [np.cumsum(d) for d, _, _ in got]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([n * use[k] for _, n, use in got]), len(every)).astype(np.uint64) for k in (0, 1)]
    words = (every & np.uint64(3)) == SECOND
    totals = np.array([np.count_nonzero(words & (sums[0] + sums[1] > 0)), sums[0][words].sum(), sums[1][words].sum()], np.uint64)
    scored, data, start = [], [], 0
    for own, (_, _, use) in zip(keys, got, strict=True):
        if use[2]:
            mine = at[start : start + len(own)]
            data.append(packed(sums[0][mine], sums[1][mine], totals))
        scored.append(bool(use[2]))
        start += len(own)
    t = t.filter(pa.array(scored))
    return t.set_column(2, t.schema.field("data"), pa.array(data, t.schema.field("data").type))


def losses(c: np.ndarray, before: np.ndarray, uni: np.ndarray, total: float, v: int, weight: float) -> np.ndarray:
    """Of bigrams seen c times, their first words before times and their second words uni times; a first word never seen leaves it all to the unigrams."""
    back = np.where(before > 0, 1 - weight, 1.0)
    return -np.log(weight * c / np.where(before > 0, before, 1) + back * (uni + 1) / (total + v))


class Model:
    """Two corpora, the vocabulary (None: all their words) and the smoothing; score() counts and answers in one pass."""

    def __init__(self, target: DataFrame, background: DataFrame, vocab: list[str] | None, weight: float):
        self.target, self.background, self.vocab, self.weight = target, background, vocab, weight


def fit(target: DataFrame, background: DataFrame, size: int | None = None, weight: float = 0.7) -> Model:
    """A model of two corpora, each with a column text; all their texts are counted. size: of the vocabulary, if not all words."""
    both = target.select("text").unionByName(background.select("text"))
    return Model(target, background, None if size is None else vocabulary(both, size), weight)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (sums of nats) and score (their difference for each token).

    Documents that are the model's background are read once for both.
    """
    kind = docs.schema["doc_id"].dataType
    use = lambda df, doc_id, *flags: df.select(doc_id.alias("doc_id"), "text", *(F.lit(bool(x)).alias(n) for x, n in zip(flags, ("__target", "__background", "__scored"), strict=True)))
    none, same = F.lit(None).cast(kind), model.background is docs
    rows = use(model.target, none, 1, 0, 0).unionByName(use(docs, F.col("doc_id"), 0, same, 1))
    if not same:
        rows = rows.unionByName(use(model.background, none, 0, 1, 0))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = f"part bigint, chunk bigint, data binary, ids array<{kind.simpleString()}>"
    sent = _sent(rows, model.vocab, max(1, -(-size // BUCKET_BYTES)), schema)
    vocab, weight = model.vocab, model.weight

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        ids = t["ids"][0].values
        words, x = unpacked(t["data"][0].as_py())
        got = [unpacked(d.as_py()) for d in t["data"][1:]]
        n_words, n_target, n_background = (int(n) for n in sum(g[2] for g in got))
        v = (n_words if vocab is None else len(vocab)) + 2
        scale = n_target / n_background if n_target and n_background else 1.0
        first, second, bigrams = keys_of(words, x)
        names = mixed(words, SECOND), mixed(words, FIRST)
        keys, at = np.unique(bigrams, return_inverse=True)
        every = np.sort(np.concatenate([keys, *names]))
        doc = np.cumsum(x == 0)[np.flatnonzero(x[1:]) + 1] - 1
        m, out = np.bincount(doc, minlength=len(ids)), []
        for k, total in ((0, n_target), (1, n_background * scale)):
            n = np.concatenate([g[k] for g in got]).astype(np.float64) * (scale if k else 1.0)
            of = lambda some, n=n: n[np.searchsorted(every, some)]
            uni, before = of(names[0]), of(names[1])
            out.append(np.bincount(doc, losses(of(keys)[at], before[first], uni[second], total, v, weight), len(ids)))
        diff = pa.array((out[0] - out[1]) / np.maximum(m, 1), mask=m == 0)
        return pa.table([ids, pa.array(m), pa.array(out[0]), pa.array(out[1]), diff], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    answered = sent.groupBy("part").applyInArrow(_answered, schema)
    return answered.groupBy("chunk").applyInArrow(run, f"doc_id {kind.simpleString()}, n_tokens bigint, target_loss double, background_loss double, score double")
