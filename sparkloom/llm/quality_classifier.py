"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x): all grades share the weights of
hashed character n-grams, thresholds are ordered.  Every document gets its
expected grade and the tail probability P(grade >= ``least_grade``) by which it is
selected.  In the tables here the grades are 0 for low quality, 1 for good but
toxic and 2 for good texts, so the tail from 1 is the probability of quality.

``sample_rows`` bounds the labelled rows that are learned from.

Defined cases: null and empty texts hold no n-gram and get the thresholds'
grade; repeated rows score equally; of several labels of one doc_id the largest
grade counts; n-grams that tell grades apart equally well are taken by bucket
number; a long text is read whole, in blocks; without labels all grades are
equally likely; a null doc_id or grade (unknown quality, whatever ``toxic`` says)
is never a label; empty tables give empty results; columns other than doc_id and
text of the documents are not read, so their names don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import linear_text as lt

GRAMS = lt.Grams((1, 2, 3), lower=False)


def graded(quality: str = "quality", toxic: str = "toxic") -> F.Column:
    """0, 1 or 2 from the two labels; null where quality is unknown."""
    return F.when(F.col(quality) == 0, 0).when((F.col(quality) == 1) & (F.col(toxic) == 1), 1).when(F.col(quality) == 1, 2)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _thresholds(x: np.ndarray) -> np.ndarray:
    return x[0] + np.append(0.0, np.cumsum(np.exp(x[1:])))


def best_buckets(counts: np.ndarray, texts: np.ndarray, features: int, least: int = 4) -> np.ndarray:
    """Buckets whose texts' mean grade differs most from that of all, in standard errors."""
    grade, n, held = np.arange(texts.size)[:, None], texts.sum(), counts.sum(axis=0)
    mean = (grade[:, 0] * texts).sum() / n
    var = (grade[:, 0] ** 2 * texts).sum() / n - mean**2
    z = np.abs((grade * counts).sum(axis=0) - held * mean) / np.sqrt(np.maximum(held * var * (1 - held / n), 1e-9))
    z[(held < least) | (held == n)] = 0
    order = np.argsort(-z, kind="stable")[:features]
    return np.sort(order[z[order] > 3.5])


def fit(docs: DataFrame, labels: DataFrame, grade: F.Column, grades: int, sample_rows: int = 20_000, features: int = 2048, ridge: float = 3e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, weights and the grades - 1 thresholds."""
    sample = lt.labelled_sample(docs, labels, grade, ~lt.held_out_rows(), sample_rows).persist()
    try:
        counts, texts = lt.bucket_counts(sample, GRAMS, grades)
        upto = np.cumsum(texts + 0.5)[:-1] / (texts + 0.5).sum()
        cuts = np.log(upto / (1 - upto))
        if (texts > 0).sum() < 2:
            return np.zeros(0, np.int64), np.zeros(0), cuts
        buckets = best_buckets(counts, texts, features)
        y, on, starts = lt.active_features(sample, GRAMS, buckets)
    finally:
        sample.unpersist()
    row, t = np.repeat(np.arange(y.size), np.diff(starts)), grades - 1

    def gradient(x: np.ndarray) -> np.ndarray:
        theta, z = _thresholds(x[:t]), lt.sums(on, starts, x[t:])
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        high, low = _sigmoid(edges[y + 1] - z), _sigmoid(edges[y] - z)
        high, low = np.where(y == t, 1.0, high), np.where(y == 0, 0.0, low)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p / y.size, low * (1 - low) / p / y.size
        d_theta = np.bincount(y[y > 0] - 1, d_low[y > 0], t) - np.bincount(y[y < t], d_high[y < t], t)
        steps = np.append(1.0, np.exp(x[1:t]))
        return np.concatenate([np.cumsum(d_theta[::-1])[::-1] * steps, np.bincount(on, (d_high - d_low)[row], x.size - t) + ridge * x[t:]])

    begin = np.append(cuts[0], np.log(np.maximum(np.diff(cuts), 1e-3)))
    x = lt.descend(gradient, np.concatenate([begin, np.zeros(buckets.size)]))
    return buckets, x[t:], _thresholds(x[:t])


def score_documents(docs: DataFrame, labels: DataFrame, grade: F.Column | None = None, grades: int = 3, least_grade: int = 1, cut: float = 0.5, **params) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability and selected for every document."""
    buckets, weights, theta = fit(docs, labels, graded() if grade is None else grade, grades, **params)

    def finish(z: np.ndarray) -> list[pa.Array]:
        above = 1 - _sigmoid(theta[None, :] - z[:, None])
        return [pa.array(above.sum(axis=1)), pa.array(above[:, least_grade - 1].copy())]

    out = lt.linear_scores(docs, GRAMS, buckets, weights, finish, ["expected_grade", "tail_probability"], "doc_id long, expected_grade double, tail_probability double")
    return out.select("doc_id", lt.held_out_rows().alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= cut).alias("selected"))
