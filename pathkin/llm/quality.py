"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text becomes a handful of statistics (lengths, shares of kinds of characters, repetition of words and
lines). cos(Wx + b) with Gaussian W approximates a Gaussian kernel over them. Ridge weights solve the
normal equations, whose sums each partition makes for its rows; the driver adds partitions and solves a
system as wide as the features. Pool-adjacent-violators turns ridge scores into probabilities.

The fit uses at most ``labelled`` labelled texts, drawn by hash of doc_id; scoring covers every text in full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, id_bucket, table, tune
from .toxicity import by_hash

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SPACE = bytes([32, *range(9, 14)])
_STOPS = b".,;:"
_MARKS = b"!?"
_OTHER = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGITS + _STOPS + _MARKS)
_WIDE = bytes(range(128, 256))
WIDTH = 20


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode()
    n = len(data)
    if not n:
        return [0.0] * WIDTH
    words = data.split()
    w = len(words)
    lines = [x for x in data.split(b"\n") if x]
    kinds = [n - len(data.translate(None, k)) for k in (_UPPER, _LOWER, _DIGITS, _SPACE, _STOPS, _MARKS, _OTHER, _WIDE)]
    letters = kinds[0] + kinds[1] + 1
    lengths = np.fromiter(map(len, words), np.float64, w) if w else np.zeros(1)
    pairs = set(zip(words, words[1:]))
    return [
        np.log1p(n), np.log1p(w), np.log1p(len(lines)), kinds[0] / letters, *(k / n for k in kinds[1:]),
        lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(set(words)) / max(1, w), len(pairs) / max(1, w - 1), len(set(lines)) / max(1, len(lines)),
        np.log1p(w / max(1, len(lines))), sum(x[-1] in b".,;:!?" for x in words) / max(1, w), sum(x[:1].isupper() for x in words) / max(1, w),
    ]


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the best non-decreasing fit, by pooling adjacent violators."""
    order = np.argsort(scores, kind="stable")
    x, first = np.unique(scores[order], return_index=True)
    weight = np.diff(np.append(first, len(order))).astype(float)
    total = np.add.reduceat(labels[order].astype(float), first)
    blocks: list[list[float]] = []  # sum, weight, first and last score
    for s, n, at in zip(total, weight, x):
        blocks.append([s, n, at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, _, last = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += n2
            blocks[-1][3] = last
    knots = [(at, s / n) for s, n, low, high in blocks for at in ([low, high] if high > low else [low])]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Model:
    def __init__(self, mean, std, w, b):
        self.mean, self.std, self.w, self.b = mean, std, w, b
        self.beta, self.knots = np.zeros(len(b) + 1), (np.zeros(1), np.full(1, 0.5))

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -8, 8)
        return np.hstack((np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))))

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Probabilities; a small slope along the ridge score keeps their order within a flat step."""
        raw = self.features(stats) @ self.beta
        flat = np.interp(raw, *self.knots)
        return np.clip(0.999 * flat + 0.001 * np.clip(raw, 0, 1), 0, 1)


def train(docs: DataFrame, labels: DataFrame, holdout=(3, 1), labelled: int = 20000, features: int = 400, width: float = 3.0, ridge: float = 1e-3, seed: int = 11) -> Model:
    import pyarrow as pa

    known = labels.select("doc_id", "quality").filter((id_bucket("doc_id", holdout[0]) != holdout[1]) & F.col("quality").isNotNull())
    chosen = by_hash(known, labelled, 8)
    # at most ``labelled`` ids, a proven bound for the broadcasts, and one text of each
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min("text").alias("text"))

    def measure(batches):
        for batch in batches:
            rows = [np.array(statistics(t), np.float64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    truth = known.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.max("quality").cast("double").alias("y"))
    rows = durable(sample.mapInArrow(measure, f"_id {kind}, x array<double>").join(truth, "_id").select("x", "y"), "quality-sample")

    def matrices(batch):
        return np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, WIDTH), np.array(batch.column(1).to_pylist(), np.float64)

    def moments(batches):
        total = np.zeros(2 * WIDTH + 1)
        for batch in batches:
            x, _ = matrices(batch)
            total += np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def added(frame: DataFrame) -> np.ndarray:
        return sum((np.frombuffer(r["sums"]) for r in frame.collect()), np.zeros(1))

    sums = added(rows.mapInArrow(moments, "sums binary"))
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 1 / width, (WIDTH, features)), rng.uniform(0, 2 * np.pi, features)
    if len(sums) == 1 or not sums[0]:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), w, b)
    n, mean = sums[0], sums[1 : WIDTH + 1] / sums[0]
    std = np.sqrt(np.maximum(sums[WIDTH + 1 :] / n - mean**2, 0))
    model = Model(mean, np.where(std > 1e-9, std, 1.0), w, b)
    size = features + 1

    def normal(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            x, y = matrices(batch)
            z = model.features(x)
            total += z.T @ np.column_stack((z, y))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    sums = added(rows.mapInArrow(normal, "sums binary")).reshape(size, size + 1)
    penalty = np.eye(size) * ridge * n / features
    penalty[-1, -1] = 0
    model.beta = np.linalg.solve(sums[:, :-1] + penalty + 1e-9 * np.eye(size), sums[:, -1])

    def raw(batches):
        for batch in batches:
            x, y = matrices(batch)
            yield pa.RecordBatch.from_arrays([pa.array(model.features(x) @ model.beta), pa.array(y)], ["raw", "y"])

    got = rows.mapInArrow(raw, "raw double, y double").toArrow()
    model.knots = isotonic(got["raw"].to_numpy(), got["y"].to_numpy())
    return model


def quality(docs: DataFrame, labels: DataFrame, holdout=(3, 1), **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    docs needs doc_id and text, labels doc_id and quality (0, 1 or null; of several rows of an id the largest counts, and of several texts the smallest); other columns are not read.
    Null and empty texts have all statistics 0 and score accordingly. Repeated rows score alike.
    Without labels every score is 0.5 or close to it. Null ids hash as the empty text and have no label. An empty table gives an empty result.
    """
    import pyarrow as pa

    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(train(docs, labels, holdout, **options))  # of fixed size but for the knots, at most two a sampled text

    def run(batches):
        model = shared.value
        for batch in batches:
            score = model.score(np.array([statistics(t) for t in batch.column(2).to_pylist()], np.float64).reshape(-1, WIDTH))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = id_bucket("doc_id", holdout[0]) == holdout[1]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op8_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
