"""Toxicity over the whole vocabulary, and calibration with few toxic labels."""

import random

import numpy as np

from duebook.llm import toxicity

SCHEMA = "doc_id long, text string"


def labelled(n, share, seed=3):
    """One word goes with most toxic rows; each of the others has a word of a small set."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
             for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = rng.random() < share
        if toxic:
            words[4] = "zworst" if rng.random() < 0.9 else f"q{rng.choice('xyz')}"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_every_term_of_the_examples_counts(spark):
    rows, labels = labelled(600, 0.3)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    own = set(model.ids.tolist())
    held = {t for i, text in rows if i in own for t in toxicity.terms_of(text.encode())}
    assert set(model.terms) == held and {b"zworst", b"qx", b"qy", b"qz"} <= held
    assert (model.by_term > 0).all()
    assert len(model.ids) == len(own) > 300
    assert (np.diff(model.weights.at) > 0).all()


def test_calibration_has_both_labels(spark):
    rows, labels = labelled(900, 0.12)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    chosen, learn = toxicity.sampled(marks)
    parts = {(r.part, r.toxic): r["count"] for r in chosen.groupBy("part", "toxic").count().collect()}
    assert set(parts) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert sum(parts.values()) == learn.count()
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA), marks)
    assert (model.slope, model.intercept) != (1.0, 0.0)


def test_logistic_settles():
    rng = np.random.default_rng(1)
    for n in (3, 100, 400):
        x = np.where(rng.random(n) < 0.9, -6.9, 6.9) + rng.normal(size=n) * 0.01
        for y in (np.zeros(n), (x > 0).astype(float), (rng.random(n) < 0.1).astype(float)):
            a, b = toxicity.logistic(x, y)
            p = 1 / (1 + np.exp(-(a * x + b)))
            assert np.allclose([((p - y) * x).sum() + a - 1, (p - y).sum() + 0.01 * b], 0, atol=1e-3)


def test_sparse_search_is_exact():
    rng = np.random.default_rng(2)
    share = np.concatenate([np.full(10, 0.6), np.full(500, 0.02)])
    rows, asked = (toxicity.unit(rng.random((n, 510)) * (rng.random((n, 510)) < share))
                   for n in (300, 80))
    found = toxicity.BlockMaxIndex(rows).nearest(asked, 5)
    cosine = np.round(asked @ rows.T, 12)
    want = np.lexsort((np.tile(np.arange(300), (80, 1)), -cosine), axis=1)[:, :5]
    assert (found.example == want).all()
    assert np.allclose(found.cosine, np.take_along_axis(cosine, want, 1))
