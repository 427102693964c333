"""Quality classification by regularised quadratic discriminant analysis over transformed document statistics.

Each text becomes a short vector of counts and shares, moved to the real line by logarithms and logits. Per class, a mean and a covariance
shrunk towards the pooled and the spherical one give a Gaussian; its Cholesky factor is computed once and shipped with the model. The
score is the calibrated difference of the two log-densities (Mahalanobis terms and log-determinants) plus the log prior odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bucket_of, byte_blocks, flat, saved
from cairn.llm.shingles import mix, word_hashes

FEATURES = ["log_bytes", "log_words", "word_bytes", "upper", "symbols", "digits", "stops", "non_ascii", "no_letter_words", "distinct_words", "distinct_pairs", "repeats", "top_word", "log_lines"]
#: Weight of the pooled covariance, and of the sphere of its mean variance.
POOLED, SPHERE = 0.3, 0.05
THRESHOLD = 0.3
_EPS = 2e-3

_KIND = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 symbol, 3 digit, 4 stop, 5 non-ASCII, 6 line end
_KIND[65:91] = 1
_KIND[list(b"!\"#$%&'()*+-/<=>@[\\]^_`{|}~")] = 2
_KIND[48:58] = 3
_KIND[list(b".,;:?")] = 4
_KIND[128:] = 5
_KIND[10] = 6
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _logit(share: np.ndarray) -> np.ndarray:
    return np.log((share + _EPS) / (1 - share + _EPS))


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """A (rows, features) matrix per block of rows; null and empty texts are all zero counts."""
    for a, b in byte_blocks(texts):
        data, off = flat(texts.slice(a, b - a))
        rows, size = b - a, np.diff(off).astype(float)
        row_of = np.repeat(np.arange(rows), np.diff(off))
        kinds = np.bincount(row_of * 7 + _KIND[data], minlength=rows * 7).reshape(rows, 7).astype(float)
        hashes, n = word_hashes(data, off)
        space = np.isin(data, np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8))
        spaces = np.bincount(row_of[space], minlength=rows)
        # words without a letter: the words less those that hold one
        word_start = ~space & np.concatenate([[True], space[:-1]]) if len(data) else space
        if len(data):
            word_start[off[:-1][off[:-1] < len(data)]] = ~space[off[:-1][off[:-1] < len(data)]]
        word_no = np.cumsum(word_start) - 1
        lettered = np.zeros(len(hashes), bool)
        lettered[word_no[_LETTER[data] & ~space]] = True
        ends = np.cumsum(n)
        out = np.zeros((rows, len(FEATURES)))
        for i in range(rows):
            w = hashes[ends[i] - n[i] : ends[i]]
            k = len(w)
            if not k:
                out[i, 8:13] = _logit(np.array([0.0, 1.0, 1.0, 0.0, 0.0]))
                continue
            s = np.sort(w)
            cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            runs = np.diff(cut)
            pairs = np.sort(mix(w[:-1] * np.uint64(3) + w[1:]))
            distinct_pairs = (1 + int((pairs[1:] != pairs[:-1]).sum())) / (k - 1) if k > 1 else 1.0
            out[i, 8:13] = _logit(np.array([1 - lettered[ends[i] - k : ends[i]].mean(), len(runs) / k, distinct_pairs, (w[1:] == w[:-1]).mean() if k > 1 else 0.0, runs.max() / k]))
        seen = np.maximum(size, 1)
        out[:, 0], out[:, 1] = np.log1p(size), np.log1p(n)
        out[:, 2] = np.log1p((size - spaces) / np.maximum(n, 1))
        for j, kind in ((3, 1), (4, 2), (5, 3), (6, 4), (7, 5)):
            out[:, j] = _logit(kinds[:, kind] / seen)
        out[:, 13] = np.log1p(kinds[:, 6])
        yield out


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the feature vector of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.concatenate(list(features(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Means, Cholesky factors and log-determinants of both classes; the calibration turns the log-odds into a probability."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_prior: float
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        terms = []
        for c in (0, 1):
            z = np.linalg.solve(self.factors[c], (x - self.means[c]).T)
            terms.append(-0.5 * (z * z).sum(0) - 0.5 * self.log_dets[c])
        return np.clip(terms[1] - terms[0] + self.log_prior, -60, 60)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.log_odds(x) + self.shift, -50, 50)))


def fit(train: DataFrame) -> Discriminant | None:
    """Fits on ``train(x, y)`` with y 0 or 1; None unless both classes occur.

    Only moments reach the driver: per class a count, d sums and d * d products, added up on the executors.
    """
    d = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, d)
            y = np.array(batch.column(1).to_pylist())
            for c in (0, 1):
                m = x[y == c]
                total[c] += np.concatenate([[len(m)], m.sum(0), (m.T @ m).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1])), pa.array(np.tile(np.arange(total.shape[1]), 2)), pa.array(total.ravel())], ["y", "k", "v"])

    got = np.zeros((2, 1 + d + d * d))
    for r in train.select("x", "y").mapInArrow(moments, "y long, k long, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect():
        got[r.y, r.k] = r.v
    n = got[:, 0]
    if not n.all():
        return None
    means = got[:, 1 : 1 + d] / n[:, None]
    covs = [got[c, 1 + d :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    scale = np.trace(pooled) / d
    shrunk = [(1 - POOLED - SPHERE) * c + POOLED * pooled + SPHERE * scale * np.eye(d) + 1e-9 * np.eye(d) for c in covs]
    factors = np.stack([np.linalg.cholesky(c) for c in shrunk])
    model = Discriminant(means, factors, 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1), float(np.log(n[1] / n[0])))
    model.slope, model.shift = calibrate(train, model)
    return model


def calibrate(train: DataFrame, model: Discriminant) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the training log-odds, from a histogram of 241 bins per class."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = shared.value.log_odds(np.array(batch.column(0).to_pylist()).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array(np.round(z * 2).astype(np.int64)), batch.column(1)], ["z", "y"])

    rows = train.select("x", F.col("y").cast("long").alias("y")).mapInArrow(bins, "z long, y long").groupBy("z", "y").count().collect()
    z, y, n = (np.array([r[i] for r in rows], float) for i in range(3))
    z, w = z / 2, np.array([0.3, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (n * (y - p)) - np.array([1e-3 * w[0], 0.0])
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns from labels (quality 0 or 1; others and null are left out) of ids whose crc32 modulo 5 is not 0. Null and empty texts get the score of
    an all-zero vector; equal texts get equal scores; without both classes every score is 0.5. Rows without an id are not held out and have no label. An empty table gives no rows.
    """
    held = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False))
    x = saved(document_features(docs), "quality")
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("long").alias("y"))
    model = fit(x.where(~held).join(known, "doc_id").select("x", "y"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.array(batch.column(1).to_pylist()).reshape(batch.num_rows, -1)
                s = shared.value.score(v) if shared.value else np.full(len(v), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    return x.select("doc_id", "x").mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
