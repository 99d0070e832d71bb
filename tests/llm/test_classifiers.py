"""Features and fits of the two classifiers against loops over a few dozen texts."""

from math import exp, log

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import linear_text as lt
from sparkloom.llm import quality_classifier, toxicity
from tests.llm import brute

WORDS = 1 << 64


def bucket(gram):
    h = 0
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % WORDS
    return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % WORDS) >> (64 - lt.BUCKET_BITS)


def features(text, orders, lower):
    text = brute.lower(text) if lower else text or ""
    return {bucket(text[k : k + n]) for n in orders for k in range(len(text) - n + 1)}


@pytest.mark.parametrize("block", [1 << 18, 17])
@pytest.mark.parametrize("grams", [toxicity.GRAMS, quality_classifier.GRAMS])
def test_features(grams, block, monkeypatch):
    """Also where n-grams cross a block's edge within a text."""
    monkeypatch.setattr(lt, "BLOCK_CHARS", block)
    texts = [None, "", "a", "Ab", "Some TEXT of a few words, é中\U0001f600 and more of them", "x" * 100, "tail"]
    row, found = grams.present(pa.array(texts))
    for k, t in enumerate(texts):
        assert set(found[row == k].tolist()) == features(t, grams.orders, grams.lower)
        assert (row == k).sum() == len(features(t, grams.orders, grams.lower))


def labelled(n=60):
    rng = np.random.default_rng(3)
    bad, fine = ["awful", "nasty", "vile"], ["kind", "plain", "calm"]
    texts, toxic = [], []
    for k in range(n):
        toxic.append(k % 3 == 0)
        texts.append(" ".join([*rng.choice(["some", "words", "here", "and", "there"], 8), str(rng.choice(bad if toxic[-1] else fine))]))
    return texts, [int(x) for x in toxic]


def adam(gradient, x, steps=400, rate=0.05):
    m, v = [0.0] * len(x), [0.0] * len(x)
    for k in range(1, steps + 1):
        g = gradient(x)
        for i, d in enumerate(g):
            m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
            x[i] -= rate * (1 - k / (steps + 1)) * m[i] / (1 - 0.9**k) / ((v[i] / (1 - 0.999**k)) ** 0.5 + 1e-8)
    return x


def tables(spark, texts, values, column):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(values)), f"doc_id long, {column} int")


def test_toxicity_by_loops(spark):
    texts, toxic = labelled()
    train = [k for k in range(len(texts)) if brute.crc(k) % 4 != 2]
    held = [features(t, (3, 4, 5, 6), True) for t in texts]
    counts = {}
    for k in train:
        for b in held[k]:
            counts.setdefault(b, [0, 0])[toxic[k]] += 1
    size, n = 1 << lt.BUCKET_BITS, [sum(toxic[k] == c for k in train) for c in (0, 1)]
    total = [sum(c[i] for c in counts.values()) + size for i in (0, 1)]
    chosen = []
    for b, c in sorted(counts.items()):
        want, here = sum(c) * n[1] / sum(n), sum(c)
        if 4 <= here < sum(n) and (c[1] - want) ** 2 / (want * (1 - here / sum(n)) * n[0] / sum(n)) > 10:
            chosen.append((b, log((c[1] + 1) / total[1]) - log((c[0] + 1) / total[0])))

    def gradient(x):
        g = [0.0] + [1e-3 * w for w in x[1:]]
        for k in train:
            on = [i for i, (b, _) in enumerate(chosen, 1) if b in held[k]]
            error = (1 / (1 + exp(-(x[0] + sum(x[i] * chosen[i - 1][1] for i in on)))) - toxic[k]) / len(train)
            g[0] += error
            for i in on:
                g[i] += error * chosen[i - 1][1]
        return g

    x = adam(gradient, [log((n[1] + 0.5) / (n[0] + 0.5))] + [0.0] * len(chosen))
    want = [1 / (1 + exp(-(x[0] + sum(x[i] * r for i, (b, r) in enumerate(chosen, 1) if b in f)))) for f in held]
    docs, labels = tables(spark, texts, toxic, "toxic")
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert chosen and [out[k]["score"] for k in range(len(texts))] == pytest.approx(want, abs=1e-6)
    assert [out[k]["held_out"] for k in range(len(texts))] == [brute.crc(k) % 4 == 2 for k in range(len(texts))]


def test_quality_by_loops(spark):
    texts, toxic = labelled(45)
    grade = [0 if t else 1 + k % 2 for k, t in enumerate(toxic)]
    texts = [t + (" fine" if g == 2 else "") for t, g in zip(texts, grade, strict=True)]
    train = [k for k in range(len(texts)) if brute.crc(k) % 4 != 2]
    held = [features(t, (1, 2, 3), False) for t in texts]
    mean = sum(grade[k] for k in train) / len(train)
    var = sum(grade[k] ** 2 for k in train) / len(train) - mean**2
    by = {}
    for k in train:
        for b in held[k]:
            by.setdefault(b, []).append(grade[k])
    chosen = [b for b, g in sorted(by.items()) if 4 <= len(g) < len(train) and abs(sum(g) - len(g) * mean) / (len(g) * var * (1 - len(g) / len(train))) ** 0.5 > 3.5]
    sigmoid = lambda z: 1 / (1 + exp(-z))
    cuts = [log(u / (1 - u)) for u in (sum(sum(grade[k] == g for k in train) + 0.5 for g in range(c + 1)) / (len(train) + 1.5) for c in (0, 1))]

    def loss_gradient(x):
        theta, g = (x[0], x[0] + exp(x[1])), [0.0, 0.0] + [3e-4 * w for w in x[2:]]
        for k in train:
            z = sum(w for w, b in zip(x[2:], chosen, strict=True) if b in held[k])
            high = sigmoid(theta[grade[k]] - z) if grade[k] < 2 else 1.0
            low = sigmoid(theta[grade[k] - 1] - z) if grade[k] else 0.0
            up, down = high * (1 - high) / (high - low) / len(train), low * (1 - low) / (high - low) / len(train)
            g[0] -= up - down  # both thresholds move with the first
            g[1] -= exp(x[1]) * (up * (grade[k] == 1) - down * (grade[k] == 2))
            for i, b in enumerate(chosen, 2):
                if b in held[k]:
                    g[i] += up - down
        return g

    x = adam(loss_gradient, [cuts[0], log(cuts[1] - cuts[0])] + [0.0] * len(chosen))
    docs, labels = tables(spark, texts, grade, "grade")
    out = {r["doc_id"]: r for r in quality_classifier.score_documents(docs, labels, "grade").collect()}
    assert chosen
    for k, f in enumerate(held):
        z = sum(w for w, b in zip(x[2:], chosen, strict=True) if b in f)
        above = [1 - sigmoid(x[0] - z), 1 - sigmoid(x[0] + exp(x[1]) - z)]
        assert out[k]["tail_probability"] == pytest.approx(above[0], abs=1e-6) and out[k]["expected_grade"] == pytest.approx(sum(above), abs=1e-6)


def test_unknown_quality_is_no_label(spark):
    rows = [(0, 1), (0, 0), (1, 1), (1, 0), (1, None), (None, 1), (None, None)]
    out = spark.createDataFrame(rows, "quality int, toxic int").select(quality_classifier.graded().alias("g")).collect()
    assert [r["g"] for r in out] == [0, 0, 1, 2, 2, None, None]


def test_sample_is_bounded(spark):
    """Many rows under one labelled doc_id don't exceed sample_rows."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(k, "other") for k in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id long, toxic int")
    assert lt.labelled_sample(docs, labels, "toxic", F.lit(True), 20).count() == 20
