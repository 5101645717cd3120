"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics come from whole texts and from nothing else. The model is fitted on at most `each` labelled rows of either
class outside the held fold (a documented bound), taken in the order of a hash of their ids: the normal equations of
the random features are summed within partitions, the sums are summed again, and the driver solves one system of
`features` unknowns. Isotonic calibration is fitted on the quarter of the sample that the ridge did not see.

Edge cases: null and empty texts have all-zero statistics and a score like any other. Labels other than 0 and 1 and
null ids are not learned from. With labels of one class, or none, every score is the share of that class (0.5 for
none). Repeated rows are scored alike; equal raw scores are one knot of the calibration, whatever their rows' order.
Very long texts are read whole, one at a time. Scoring keeps all rows; kept() keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, texts
from .learning import class_sizes, isotonic, labelled, sample_of

#: The byte classes that are counted.
UPPER, DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
SYMBOLS, BARS, BANGS, STOPS, PUNCT = b"#*$%&<>@^~_=+{}[]\\/", b"|", b"!?", b".", b",;:'\"()-"
N_STATS = 22


def statistics(text: bytes) -> list[float]:
    """Shape, repetition and symbol statistics of a whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_STATS
    share = lambda chars: (size - len(text.translate(None, chars))) / size
    size, letters = len(text), sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    sentences = [x.strip() for x in text.split(b".") if x.strip()]
    wide = np.fromiter(map(len, words), np.float64, n)
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)  # noqa: B905
    return [
        np.log1p(n) / 10, np.log1p(size) / 12, letters / n / 10, wide.std() / 10, wide.max() / 50,
        len(counts) / n, len(counts) / n**0.7 / 5, max(counts.values()) / n, pairs,
        share(UPPER) * 2, share(DIGIT) * 4, min(1.0, share(SYMBOLS) * 5), min(1.0, share(BARS) * 10), min(1.0, share(BANGS) * 10), share(STOPS) * 10, share(PUNCT) * 5,
        np.log1p(len(lines)) / 8, len(set(lines)) / len(lines), min(1.0, n / len(lines) / 100),
        len(set(sentences)) / max(1, len(sentences)), min(1.0, n / max(1, len(sentences)) / 50), np.mean(wide <= 3),
    ]


def _with_stats(docs: DataFrame) -> DataFrame:
    """doc_id, __label, x: the statistics of the rows of labelled()."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t) for t in texts(batch)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__label").cast(pa.int32()), x], ["doc_id", "__label", "x"])

    return map_arrow(docs, run, f"doc_id {kind}, __label int, x array<double>")


class Model:
    """Fourier features cos(xW + b), ridge weights, calibration knots."""

    def __init__(self, mean, scale, w, b, ridge, knots, constant=None):
        self.mean, self.scale, self.w, self.b, self.ridge, self.knots, self.constant = mean, scale, w, b, ridge, knots, constant

    def random(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.random(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.interp(self.raw(x), *self.knots)


def _sums(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y, summed in each partition, then over a few tasks, then on the driver: a few matrices of fixed size."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("x").to_pylist(), np.float64)
                z, y, w = model.random(x), batch.column("__label").to_numpy().astype(float), batch.column("w").to_numpy()
                zw = z * w[:, None]
                total = total + np.hstack([zw.T @ z, zw.T @ y[:, None]])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total = total + sum(np.frombuffer(x) for x in batch.column("m").to_pylist())
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    d = model.w.shape[1] + 1
    parts = map_arrow(map_arrow(sample, part, "m binary").repartition(4), add, "m binary").collect()
    total = sum((np.frombuffer(r["m"]) for r in parts), np.zeros(d * (d + 1))).reshape(d, d + 1)
    return total[:, :d], total[:, d]


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, each: int = 6000, features: int = 512, width: float = 3.0, penalty: float = 3e-4, seed: int = 5) -> Model:
    """A model of labels.quality, from the rows outside the held fold.

    width: of the Gaussian kernel, in units of the square root of the number of statistics.
    """
    rows = _with_stats(labelled(docs, sample_of(labels, "quality", folds, held, each)))
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").limit(2 * each)  # ids may repeat
    rows = cut(rows.withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(4)) == 0).repartition(8))
    by = {r["__label"]: r["n"] for r in rows.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    if len(by) < 2:
        return Model(*[np.zeros(1)] * 6, constant=float(next(iter(by), 0.5)))
    agg = rows.agg(*(f(F.col("x")[i]) for i in range(N_STATS) for f in (F.mean, F.stddev_pop))).first()
    mean, scale = np.array(agg[::2], float), np.array(agg[1::2], float)
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1 / (width * N_STATS**0.5), (N_STATS, features))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), w, rng.uniform(0, 2 * np.pi, features), None, None)
    prior = class_sizes(labels, "quality", folds, held)
    weight = {y: prior.get(y, 1) / by[y] for y in by}  # the sample's classes stand for the whole's
    top = max(weight.values())
    rows = rows.withColumn("w", F.when(F.col("__label") == 1, weight[1] / top).otherwise(weight[0] / top))
    a, b = _sums(rows.filter(~F.col("calibrate")), model)
    model.ridge = np.linalg.solve(a + penalty * np.trace(a) / len(a) * np.eye(len(a)), b)
    rest = rows.filter("calibrate").select("x", "__label", "w").collect()
    rest = rest or rows.select("x", "__label", "w").limit(each).collect()
    raw = model.raw(np.array([r["x"] for r in rest]))
    model.knots = isotonic(raw, np.array([r["__label"] for r in rest], float), np.array([r["w"] for r in rest]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(shared.value, batch))], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def kept(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The documents with a score of at least the threshold, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch) >= threshold))

    return map_arrow(docs, run, docs.schema)


def _scores(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    x = np.array([statistics(t) for t in texts(batch)], np.float64).reshape(-1, N_STATS)
    return np.clip(model.score(x), 0, 1)
