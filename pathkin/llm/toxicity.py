"""Toxicity by non-negative positive-unlabelled learning.

The training data are confirmed toxic texts (positives) and texts of unknown label. With class prior
p, the risk of a classifier g under the logistic loss l is

    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

The second term estimates the risk on negatives without having any; where it falls below zero the
model has begun to remember the positives, and the step is taken against it instead. g is linear in
the presence of words (A-Z lowered, punctuation parted) and of their first 4 and 6 bytes, with the words that few sampled texts hold left out
and small weights shrunk to zero, so that long texts gather no noise.

The fit uses a bounded sample of labelled rows: at most ``positives`` texts that are labelled toxic, and at most ``unlabelled`` texts
of labelled rows whose label is not looked at, both drawn by hash of doc_id. The class prior is the share of
toxic ones among all labels that may be learnt from, which is that of the population the unlabelled texts are drawn from; where labels hold positives only, give ``prior``.
Terms are counted and numbered on the executors; the driver gets the numbers. Scoring covers every text in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, discard, durable, id_bucket, lean, table, tune

_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_TO_WORDS = bytes(32 if b in _PUNCTUATION else b for b in ASCII_LOWER)


def terms(text: str | None) -> set[bytes]:
    """The distinct words, and as terms of their own (marked by a leading zero byte) the stems that longer words begin with."""
    found = set((text or "").encode().translate(_TO_WORDS).split())
    return found | {b"\0" + w[:4] for w in found if len(w) > 4} | {b"\0" + w[:6] for w in found if len(w) > 6}


def by_hash(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """n ids at most, the first by hash."""
    return ids.select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(n)


class Csr:
    """Rows of present features: at[starts[k] : starts[k + 1]] are those of row k."""

    def __init__(self, starts: np.ndarray, at: np.ndarray, width: int):
        self.sizes, self.at, self.width = np.diff(starts), at.astype(np.int32), width
        self.rows = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    @classmethod
    def of(cls, rows: list, width: int) -> Csr:
        return cls(np.cumsum([0, *map(len, rows)]), np.concatenate([np.zeros(0, np.int32), *[np.asarray(r, np.int32) for r in rows]]), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.at], minlength=len(self.sizes))

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=np.repeat(g, self.sizes), minlength=self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def nnpu_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk on positives and the (uncorrected) estimate of that on negatives."""
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def nnpu_gradient(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What to follow for each positive's and each unlabelled text's score: the gradient of the whole risk, or against that of the negatives' part where it is below zero."""
    sp, su = sigmoid(zp), sigmoid(zu)
    gp, gu = -prior * sp / len(zp), su / len(zu)  # of the risk on negatives
    if nnpu_risk(zp, zu, prior)[1] < 0:
        return -gp, -gu
    return gp - prior * (1 - sp) / len(zp), gu


def fit(positive: Csr, unlabelled: Csr, prior: float, steps: int = 300, rate: float = 0.1, shrink: float = 5e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``steps`` full steps of Adam, each followed by soft thresholding. Neither set may be empty."""
    theta = np.zeros(positive.width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        gp, gu = nnpu_gradient(positive.dot(theta[:-1]) + theta[-1], unlabelled.dot(theta[:-1]) + theta[-1], prior)
        g = np.append(positive.back(gp) + unlabelled.back(gu), gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        scale = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        theta -= scale * m / (1 - 0.9**t)
        w = theta[:-1]
        theta[:-1] = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(scale[:-1] * shrink, rate * 0.5))
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, holdout=(5, 0), positives: int = 3000, unlabelled: int = 5000, least_texts: int = 10, prior: float | None = None) -> tuple[dict[bytes, float], float]:
    """Weights of words, and the intercept. Labels of held-out ids are not looked at; of several labels of an id the largest counts, of several texts the smallest."""
    spark = docs.sparkSession
    kept = id_bucket("doc_id", holdout[0]) != holdout[1]
    known = labels.select("doc_id", "toxic").filter(kept & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] if prior is None else prior
    if not prior or prior >= 1:
        return {}, -5.0 if not prior else 5.0
    chosen = by_hash(known.filter("toxic = 1"), positives, 5).withColumn("_pos", F.lit(True))
    chosen = chosen.unionByName(by_hash(known, unlabelled, 6).withColumn("_pos", F.lit(False)))
    # at most positives + unlabelled ids, a proven bound for the broadcast, and one text of each
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_pos", "_id").agg(F.min("text").alias("text"))
    sample = durable(sample, "toxicity-sample")

    def each(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(list(terms(text)), pa.binary())], ["term"])

    counted = sample.select("text").mapInArrow(lean(each), "term binary").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = counted.filter(F.col("n") >= least_texts).select("term").orderBy("term").toArrow()["term"].combine_chunks()  # bounded by the sample
    shared = spark.sparkContext.broadcast(vocabulary)

    def coded(batches):
        index = {w: k for k, w in enumerate(shared.value.to_pylist())}
        for batch in batches:
            rows = [sorted(index[w] for w in terms(t) if w in index) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["pos", "id", "at"])

    kind = sample.schema["_id"].dataType.simpleString()
    rows = sample.select("_pos", "_id", "text").mapInArrow(lean(coded), f"pos boolean, id {kind}, at array<int>").orderBy("pos", "id").select("pos", "at").toArrow().combine_chunks()
    discard(sample)

    def side(pos: bool) -> Csr:
        own = rows.filter(pa.compute.equal(rows["pos"], pos))["at"].combine_chunks()
        starts = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(own).to_numpy(zero_copy_only=False))))
        return Csr(starts, own.flatten().to_numpy(zero_copy_only=False), len(vocabulary))

    one, two = side(True), side(False)
    if not len(one.sizes) or not len(two.sizes):
        return {}, float(np.log(prior / (1 - prior)))
    weights, intercept = fit(one, two, prior)
    return {vocabulary[int(k)].as_py(): float(weights[k]) for k in np.flatnonzero(weights)}, intercept


def score_texts(docs: DataFrame, model: tuple[dict[bytes, float], float], holdout=(5, 0)) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text)."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        weights, intercept = shared.value
        get = weights.get
        for batch in batches:
            z = np.array([intercept + sum(get(w, 0.0) for w in sorted(terms(t) & weights.keys())) for t in batch.column(2).to_pylist()])
            score = sigmoid(z)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = id_bucket("doc_id", holdout[0]) == holdout[1]
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, holdout=(5, 0), threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns, in one pass over the texts; see toxicity() for nulls, repeats and missing labels."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, holdout, **options))
    place = docs.columns.index("text")

    def run(batches):
        weights, intercept = shared.value
        for batch in batches:
            z = [intercept + sum(weights[w] for w in sorted(terms(t) & weights.keys())) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(sigmoid(np.array(z)) < threshold, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, holdout=(5, 0), **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    docs needs doc_id and text, labels doc_id and toxic (0, 1 or null); other columns are not read. Null
    and empty texts get the score of a text without known words. Repeated rows score alike. Without
    labels, with labels of one kind only, or if no labelled text is in docs, every text gets the same score. Null ids hash as the
    empty text and have no label. An empty table gives an empty result.
    """
    tune(docs.sparkSession)
    return score_texts(docs, train(docs, labels, holdout, **options), holdout)


def op2_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
