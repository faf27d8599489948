"""Toxicity by non-negative positive-unlabelled learning.

A logistic classifier over hashed words and word beginnings learns from confirmed toxic texts and unlabelled texts with the
risk  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),  the class prior being the
share of toxic rows among the labelled training rows. Where the second part falls below zero the step
goes against it, so flexible models don't overfit the positives.

The classifier is fitted on bounded samples, MAX_POSITIVE and MAX_UNLABELLED texts chosen by a hash of
their id; scoring covers every text. Defined cases: null and empty texts have no words and get the bias
alone; without positives the score is 0 everywhere; rows without a label are unlabelled; an id labelled
twice counts as toxic if any of its rows is; repeated rows are scored alike; of an id on several rows one text
(the greatest) is learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import Scratch, mapped_rows, without

DIMENSIONS = 1 << 19
MAX_POSITIVE = 8000
MAX_UNLABELLED = 16000
THRESHOLD = 0.3


def _blank_marks(text: bytes) -> bytes:
    return text.translate(_MARKS)


#: ASCII characters that are no letters become blanks.
_MARKS = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))


#: Bytes of a word's beginning that make a feature of their own, and how often it may count.
HEAD, TIMES = 6, 3
#: The first numbers stand for the text's length, in powers of two.
LENGTHS = 32


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of features of each text, their numbers, text by text).

    Features are the distinct words, the beginnings of words met once, twice and three times or more, and
    the length.
    """
    counts, (hashes, heads) = textops.word_hashes([_blank_marks(x) for x in texts], lower=True, heads=(HEAD,))
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), counts) * DIMENSIONS
    half = DIMENSIONS // 2
    word = np.unique(owner + (hashes >> np.uint64(46)).astype(np.int64))
    head, n = np.unique(owner + (heads >> np.uint64(46)).astype(np.int64), return_counts=True)
    times = [head[n >= k] for k in range(1, TIMES + 1)]
    times = [x // DIMENSIONS * DIMENSIONS + half + (textops.mix(x.astype(np.uint64) % np.uint64(DIMENSIONS) + np.uint64(k << 32)) >> np.uint64(46)).astype(np.int64) for k, x in enumerate(times)]
    length = np.arange(len(texts), dtype=np.int64) * DIMENSIONS + np.minimum(np.log2(counts + 1).astype(np.int64), LENGTHS - 1)
    key = np.unique(np.concatenate([word, *times, length]))
    return np.bincount(key // DIMENSIONS, minlength=len(texts)), (key % DIMENSIONS).astype(np.int32)


def _grouped(batch: pa.RecordBatch, column: str, size: int = 512):
    texts = textops.blobs(batch.column(column))
    for k in range(0, len(texts), size):
        yield texts[k : k + size]


def feature_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many texts have each feature; at most DIMENSIONS rows come to the driver."""

    def run(batches):
        total = np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for texts in _grouped(batch, text):
                total += np.bincount(features(texts)[1], minlength=DIMENSIONS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["word", "n"])

    found = docs.select(text).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIMENSIONS, np.int64)
    out[found["word"].to_numpy(int)] = found["n"].to_numpy(int)
    return out


def feature_table(docs: DataFrame, chosen: np.ndarray, text: str = "text") -> DataFrame:
    """The chosen features (a boolean by number) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        chosen = shared.value
        for batch in batches:
            for texts in _grouped(batch, text):
                counts, words = features(texts)
                use = chosen[words]
                owner = np.repeat(np.arange(len(counts)), counts)[use]
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(words[use]))], ["words"])

    return docs.select(text).mapInArrow(run, "words array<int>")


def _sums(weights: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[words])])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def risk(yp: np.ndarray, yu: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive, negative) parts of the risk of scores of positive and unlabelled texts; the loss is a score's distance from its label.

    The negative part, the unlabelled texts' loss as clean ones less what the toxic among them add, is below 0
    only where the model is too sure of the positives it was shown. A bounded loss keeps one such text from
    outweighing all others.
    """
    return prior * float((1 - yp).mean()), float(yu.mean() - prior * yp.mean())


def slopes(yp: np.ndarray, yu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What to follow down, by each text's logit: the gradient of the risk, or away from a negative part below 0."""
    dp, du = prior * yp * (1 - yp) / len(yp), yu * (1 - yu) / len(yu)
    if risk(yp, yu, prior)[1] >= 0:
        return -2 * dp, du
    return dp, -du


class ToxicityModel:
    def __init__(self, weights: np.ndarray | None, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        counts, words = features(texts)
        return 1 / (1 + np.exp(-np.clip(_sums(self.weights, words, counts) + self.bias, -40, 40)))

    @classmethod
    def fit(cls, positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 300, rate: float = 0.08, decay: float = 1e-5) -> ToxicityModel:
        """positives, unlabelled: arrays of feature numbers, a text each. Follows ``slopes`` with Adam's steps."""
        if not positives or not unlabelled:
            return cls(None, 0.0)
        prior = min(max(prior, 1e-4), 0.9)
        p, u = np.concatenate(positives), np.concatenate(unlabelled)
        n_p, n_u = (np.array([len(x) for x in rows], int) for rows in (positives, unlabelled))
        weights, bias = np.zeros(DIMENSIONS), float(np.log(prior / (1 - prior)))
        m, v, mb, vb = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        for step in range(1, rounds + 1):
            yp, yu = sigmoid(_sums(weights, p, n_p) + bias), sigmoid(_sums(weights, u, n_u) + bias)
            gp, gu = slopes(yp, yu, prior)
            grad = np.bincount(p, np.repeat(gp, n_p), DIMENSIONS) + np.bincount(u, np.repeat(gu, n_u), DIMENSIONS) + decay * weights
            slope = gp.sum() + gu.sum()
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * slope, 0.999 * vb + 0.001 * slope * slope
            scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            weights -= scale * m / (np.sqrt(v) + 1e-8)
            bias -= scale * mb / (np.sqrt(vb) + 1e-8)
        return cls(weights.astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> ToxicityModel:
    """docs (doc_id, text) and labels (doc_id, toxic), training rows only."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0

    def sample(ids: DataFrame, most: int) -> DataFrame:
        chosen = ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        # one text for each id, however many rows have it, so that no more than ``most`` come to the driver
        return docs.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))

    scratch = Scratch(docs.sparkSession, "toxicity")
    positives = scratch.put(sample(known.where("toxic = 1"), max_positive), "positives")
    unlabelled = scratch.put(sample(docs.where("doc_id is not null").join(known, "doc_id", "left_anti"), max_unlabelled), "unlabelled")
    chosen = different(feature_counts(positives), feature_counts(unlabelled), positives.count(), unlabelled.count())
    rows = [[np.asarray(x, np.int32) for x in feature_table(t, chosen).toPandas()["words"]] for t in (positives, unlabelled)]
    scratch.close()
    return ToxicityModel.fit(*rows, prior)


def different(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, least: float = 5.0) -> np.ndarray:
    """Features whose shares among positives and unlabelled differ by ``least`` standard errors, and the lengths.

    Only these get a weight; the bias speaks for all others.
    """
    n_p, n_u = max(n_p, 1), max(n_u, 1)
    pooled = (in_p + in_u) / (n_p + n_u)
    error = np.sqrt(np.maximum(pooled * (1 - pooled) * (1 / n_p + 1 / n_u), 1e-18))
    out = (np.abs(in_p / n_p - in_u / n_u) >= least * error) & (in_p + in_u >= 3)
    out[:LENGTHS] = True
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with score and predicted; columns of the input with these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches, kept):
        model = shared.value
        for batch in batches:
            score = np.concatenate([model.score(texts) for texts in _grouped(batch, "_in")] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*kept, "_score", "_predicted"])

    return mapped_rows(docs, without(docs, "score", "predicted"), text, run, "_score double, _predicted int", ["score", "predicted"])


def op6_toxicity_pu(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    model = train(docs.where(part != 2), labels.where(part != 2))
    scored = score_toxicity(docs.withColumn("held_out", F.coalesce(part == 2, F.lit(False))), model)
    return scored.select("doc_id", "held_out", "score", "predicted")
