import random

import numpy as np
import pyarrow as pa
import pytest

from claimforge.llm import toxicity
from claimforge.llm.common import fold_bucket
from tests.llm.helpers import DOC_SCHEMA, docs_frame


def _net(seed=1):
    rng = np.random.default_rng(seed)
    net = toxicity.Network.start(seed)
    net.p["word"] = rng.normal(size=net.p["word"].shape).astype(np.float32)
    net.word_fact = rng.normal(size=toxicity.WORD_ROWS + 1).astype(np.float32)
    net.char_fact = rng.normal(size=toxicity.CHAR_ROWS).astype(np.float32)
    return net


def test_gradients_match_differences():
    net, rng = _net(), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(7, toxicity.INPUT))
    tokens = np.array([[1, 2, 3, 2], [4, 5, 0, 0], [6, 1, 1, 0]])
    length, y, share = np.array([4, 2, 3]), np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])

    def loss():
        logit = net.run(x, tokens, length)
        return float((share * (np.logaddexp(0, logit) - y * logit)).sum())

    _, g, dx, _ = net.gradients(x, tokens, length, y, share)
    for k in ("wf", "uf", "cf", "wb", "ub", "cb", "a", "v", "out", "b"):
        flat, grad = net.p[k].reshape(-1), g[k].reshape(-1)
        for i in rng.choice(flat.size, min(5, flat.size), replace=False):
            keep = flat[i]
            flat[i] = keep + 1e-3
            up = loss()
            flat[i] = keep - 1e-3
            down = loss()
            flat[i] = keep
            assert grad[i] == pytest.approx((up - down) / 2e-3, abs=2e-4), k
    for i, j in ((1, 0), (3, 4), (6, toxicity.INPUT - 1)):
        x[i, j] += 1e-3
        up = loss()
        x[i, j] -= 2e-3
        assert dx[i, j] == pytest.approx((up - loss()) / 2e-3, abs=2e-4)
        x[i, j] += 1e-3


def test_windows_cover_whole_texts():
    off = np.array([0, 0, 5, 5 + 48, 5 + 48 + 500])
    start, length, text = toxicity.windows(off)
    for i in range(4):
        own = text == i
        seen = set()
        for a, n in zip(start[own], length[own]):
            assert n <= toxicity.WINDOW
            seen.update(range(a, a + n))
        assert seen == set(range(off[i], off[i + 1]))


def test_scores_do_not_depend_on_the_batch():
    net = _net(2)
    rng = random.Random(1)
    texts = ["", "one", " ".join(f"w{rng.randrange(50)}" for _ in range(700)), "A b!", "ß É " * 40]
    whole = net.scores(pa.array(texts, pa.large_string()))
    alone = [net.scores(pa.array([t], pa.large_string()))[0] for t in texts]
    assert np.allclose(whole, alone, atol=1e-5)


def _labelled(spark, n=500):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randrange(2, 7))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(30, 160))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(1 + len(own) // 40):
                own[rng.randrange(len(own))] = rng.choice(["zorg", "grumf"]) + rng.choice(["", "ab", "hi."])
        rows.append((i, " ".join(own), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = _labelled(spark)
    out = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").withColumn("held", fold_bucket("doc_id", 4) == 2).collect()
    held = [r for r in out if r["held"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in out)


def test_edges(spark):
    docs = docs_frame(spark, [None, "", "a b", "a b", "word " * 60000]).selectExpr("*", "lang AS score", "lang AS y", "lang AS id")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0] * 5
    labels = spark.createDataFrame([(0, 1, 1), (1, None, None), (2, 0, 1), (2, 0, 1), (3, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 5
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
