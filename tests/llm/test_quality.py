import random

import numpy as np
import pyarrow as pa
import pytest

from claimforge.llm import quality
from claimforge.llm.common import fold_bucket
from tests.llm.helpers import DOC_SCHEMA, docs_frame


def _brute(text):
    """Buckets of one text alone."""
    off, ids = quality.features(pa.array([text], pa.large_string()))
    return set(ids.tolist())


def test_features_do_not_depend_on_the_batch():
    texts = ["One two.", "", "SHOUT!! SHOUT!!", "One two.", " | a | b", "x" * 9000, "one  two."]
    off, ids = quality.features(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        own = ids[off[i] : off[i + 1]].tolist()
        assert len(own) == len(set(own)) and set(own) == _brute(t)
    assert _brute("a a") != _brute("a b") and _brute("") == set()


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    n, d = 40, 6
    x = rng.normal(size=(n, d))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=n) > 0, 1.0, -1.0)
    off, ids = np.arange(n + 1) * d, np.tile(np.arange(d), n)
    c = np.ones(n)
    w, b = quality.dual_descent(off, ids, x.ravel(), y, c, epochs=3000)
    w = w[:d]

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + (c * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()

    slack = 2 * c * np.maximum(0, 1 - y * (x @ w + b)) * y
    assert np.abs(w - slack @ x).max() < 1e-2 and abs(b - slack.sum()) < 1e-2
    assert all(loss(w, b) <= loss(w + 0.05 * rng.normal(size=d), b + 0.05 * rng.normal()) + 1e-6 for _ in range(50))


def _labelled(spark, n=400):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        good = rng.random() < 0.7
        text = " ".join(own).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in own)
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = _labelled(spark)
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).join(labels, "doc_id").withColumn("held", fold_bucket("doc_id", 5) == 0).collect()
    held = [r for r in out if r["held"]]
    assert len(held) > 40 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_edges(spark):
    docs = docs_frame(spark, [None, "", "a b", "a b", "word " * 60000]).selectExpr("*", "lang AS score", "lang AS y", "lang AS id")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, none)).collect()
    assert [r["score"] for r in got] == [pytest.approx(0.5)] * 5
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (2, 0, 1), (2, 0, 1), (4, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, labels)).count() == 5
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0
