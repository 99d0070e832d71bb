"""Toxicity by a character n-gram linear classifier with naive Bayes features.

A text's features are the hashed character n-grams that it holds (case of A-Z
aside), each scaled by its log-count ratio log(p/|p|) - log(q/|q|) between toxic
and other training texts.  Logistic regression over the ``features`` n-grams
that tell the classes apart best gives the score.

``sample_rows`` bounds the labelled rows that are learned from.

Defined cases: null and empty texts hold no n-gram and score the bias alone;
repeated rows score equally; without labels, or with labels of one class, every
score is the smoothed share of toxic labels; a null doc_id is never a label; of
several labels of one doc_id the largest counts; n-grams that tell the classes
apart equally well are taken by bucket number; a long text is read whole, in
blocks; empty tables give empty results; other columns of the documents are not
read by ``score_documents`` and kept, whatever their names, by
``clean_documents``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import linear_text as lt

GRAMS = lt.Grams((3, 4, 5, 6), lower=True)
SCORES = "doc_id long, score double"


def log_count_ratios(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = counts[1] + smooth, counts[0] + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def best_buckets(counts: np.ndarray, texts: np.ndarray, features: int, least: int = 4) -> np.ndarray:
    """Buckets of largest chi-square between presence and class, held by ``least`` texts or more."""
    n, held = texts.sum(), counts.sum(axis=0)
    want = held * texts[1] / max(n, 1)
    chi = np.where((held >= least) & (held < n), (counts[1] - want) ** 2 / np.maximum(want * (1 - held / max(n, 1)) * (texts[0] / max(n, 1)), 1e-9), 0)
    order = np.argsort(-chi, kind="stable")[:features]
    return np.sort(order[chi[order] > 10.0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 20_000, features: int = 4096, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights (ratios included) and the bias."""
    sample = lt.labelled_sample(docs, labels, label, ~lt.held_out_rows(), sample_rows).persist()
    try:
        counts, texts = lt.bucket_counts(sample, GRAMS, 2)
        prior = float(np.log((texts[1] + 0.5) / (texts[0] + 0.5)))
        if not texts.all():
            return np.zeros(0, np.int64), np.zeros(0), prior
        buckets = best_buckets(counts, texts, features)
        y, on, starts = lt.active_features(sample, GRAMS, buckets)
    finally:
        sample.unpersist()
    ratio = log_count_ratios(counts)[buckets]
    row = np.repeat(np.arange(y.size), np.diff(starts))

    def gradient(x: np.ndarray) -> np.ndarray:
        error = (1 / (1 + np.exp(-(lt.sums(on, starts, x[1:] * ratio) + x[0]))) - y) / y.size
        return np.append(error.sum(), np.bincount(on, error[row], ratio.size) * ratio + ridge * x[1:])

    x = lt.descend(gradient, np.append(prior, np.zeros(buckets.size)))
    return buckets, x[1:] * ratio, float(x[0])


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    buckets, weights, bias = fit(docs, labels, **params)
    scored = lt.linear_scores(docs, GRAMS, buckets, weights, lambda z: [pa.array(1 / (1 + np.exp(-np.clip(z + bias, -60, 60))))], ["score"], SCORES)
    return scored.select("doc_id", lt.held_out_rows().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    buckets, weights, bias = fit(docs, labels, **params)
    shipped = docs.sparkSession.sparkContext.broadcast((lt.bucket_table(buckets), weights))

    def run(batches):
        table, w = shipped.value
        for batch in batches:
            for part in lt.tk.text_slices(batch, limit=1 << 20):
                row, bucket = GRAMS.present(part.column("text"), table)
                z = np.bincount(row, w[table[bucket] - 1], part.num_rows) + bias
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))) < threshold))

    return docs.mapInArrow(lt.tk.tidy(run), docs.schema)
