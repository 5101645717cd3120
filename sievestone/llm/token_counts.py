"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi over Aho-Corasick matches.

The vocabulary is the pieces of a sentencepiece model. A model that isn't unigram has no log-probabilities; its pieces
get those of Zipf's law by their rank in the file, -ln(rank + 2), rounded to sixteenths: unigram() gives that model, which
the library itself can load. A text is prefixed by the space mark, and spaces become marks. The automaton enumerates, for
each end, the pieces that end there, the longest first; a later candidate must score strictly more, so the earliest start
wins ties, as in the library. A character without a piece of its own costs the unknown score (10 under the least) and
counts as its UTF-8 bytes where the model falls back to bytes, else as one with its unknown neighbours.

No piece reaches from before a run of space marks into it, so a text is a chain of words, and counts and scores of words
are cached. Scores are summed exactly, in units of 1/16 (or, if a model's own scores aren't such, as floats). The
library gives the same counts, for texts of a million characters too (measured; the tests compare whole tables).

Edge cases: null and empty texts have no tokens. Repeated rows and null ids are kept; an empty table gives no rows; other
columns are ignored. Very long texts are counted whole; the cache is bounded in words and bytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Known, map_arrow, texts

MARK = "▁"
MARK_BYTES = MARK.encode()
RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CACHE_WORDS = 400_000
UNIT = 16
UNIGRAM, NORMAL = 1, 1  # fixed values of the model format: model type, piece type
_COUNTERS: dict[str, Counter] = {}


def load(path: str):
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        return sentencepiece_model_pb2.ModelProto.FromString(f.read())


def unigram(proto):
    """The model as a unigram one: itself, or its normal pieces with log-probabilities by rank."""
    if proto.trainer_spec.model_type == UNIGRAM:
        return proto
    normal = [p for p in proto.pieces if p.type == NORMAL]
    for rank, p in enumerate(sorted(normal, key=lambda p: -p.score)):
        p.score = -round(UNIT * math.log(rank + 2)) / UNIT
    proto.trainer_spec.model_type = UNIGRAM
    return proto


class Counter:
    """Counts the tokens of a text under the vocabulary of one unigram model."""

    def __init__(self, proto):
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave texts as they are")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        normal = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.dummy, self.fallback = proto.normalizer_spec.add_dummy_prefix, proto.trainer_spec.byte_fallback
        self.single = {p for p in normal if len(p) == 1}
        whole = all(UNIT * s == int(UNIT * s) for s in normal.values())
        least = min(normal.values()) - 10
        self.unknown = int(least * UNIT) if whole else least
        self.automaton = ahocorasick.Automaton()
        for piece, score in normal.items():
            self.automaton.add_word(piece, (len(piece), int(score * UNIT) if whole else score))
        self.automaton.make_automaton()
        self.chained = whole and self.fallback and not any(MARK in p.lstrip(MARK) for p in normal)
        self.cache = Known(CACHE_WORDS)

    def viterbi(self, chunk: str) -> int:
        """The number of tokens on the best path; only scores and counts are carried."""
        n, automaton, single, unknown = len(chunk), self.automaton, self.single, self.unknown
        best: list = [None] * (n + 1)
        count, open_ = [0] * (n + 1), [False] * (n + 1)  # open_: the best path ends in an unknown
        best[0], end = 0, 0

        def close(e: int) -> None:
            """Nothing more ends at e: add the unknown where its character has no piece of its own."""
            c = chunk[e - 1]
            if c in single or best[e - 1] is None:
                return
            x = best[e - 1] + unknown
            if best[e] is None or x > best[e]:
                best[e], open_[e] = x, True
                count[e] = count[e - 1] + (len(c.encode()) if self.fallback else not open_[e - 1])

        for last, (size, score) in automaton.iter(chunk):
            while end < last:
                end += 1
                close(end)
            start = last + 1 - size
            if best[start] is not None:
                x, to = best[start] + score, last + 1
                if best[to] is None or x > best[to]:
                    best[to], count[to], open_[to] = x, count[start] + 1, False
        while end < n:
            end += 1
            close(end)
        return count[n]

    def __call__(self, text: bytes) -> int:
        if not text:
            return 0
        if self.chained and self.dummy and not (text.startswith(b" ") or b"  " in text or MARK_BYTES in text):
            words = text.split(b" ")
        else:
            marked = (" " * self.dummy + text.decode("utf-8", "replace")).replace(" ", MARK)
            if not self.chained or not marked.startswith(MARK):
                return self.viterbi(marked)
            words = [w[1:].encode() for w in RUNS.findall(marked)]
        return sum(self.cache.of(words, lambda new: (self.viterbi(MARK + w.decode("utf-8", "replace")) for w in new)))


def counter(path: str) -> Counter:
    """One counter for each worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(unigram(load(path)))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens of every document under the unigram vocabulary of a model file that every executor can read."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([count(t) for t in texts(batch)], pa.int64())], ["doc_id", "n_tokens"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens bigint")
