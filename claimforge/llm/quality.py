"""Quality classifier: naive Bayes support vectors over n-gram indicators.

*Features* of a text are indicators (present or not) of hashed n-grams: its words (case
kept, and without case or outer marks), pairs of words, and runs of one to three *shapes*,
a shape being a word's letter case, its outer marks, its length class and whether it
repeats the word before.  ``BUCKETS`` hash buckets.

*Fit.*  Per bucket, the class log-count ratio ``r = log((p + 1) / |p|) - log((q + 1) / |q|)``
over at most ``FIT_ROWS`` labelled training rows of each class, the first in the order of a
hash of the id.  Indicators are scaled by ``r`` and to unit length, and a linear hinge-loss
model (squared, with a bias) is fitted to these rows by dual coordinate descent.  Its margins
on up to ``CALIBRATION_ROWS`` further rows give a logistic calibration.  Only labels and texts enter; lang, source and ids do not.

*Score.*  Every whole text, per Arrow batch: words are hashed once per distinct word.

Defined results: null and empty texts have no features and get the calibrated bias;
without labels of both classes every score is the known share of label 1 (0.5 with none); of rows that repeat a labelled id the
least text trains, and every row is scored; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimforge.llm.common import byte_slices, fold_bucket, mix64, named, spread, texts_of, word_hashes, word_tokens

BUCKETS = 1 << 18
FIT_ROWS = 2000
CALIBRATION_ROWS = 1000
SLICE_BYTES = 8 << 20
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
THRESHOLD = 0.3
EPOCHS = 30
PENALTY = 1.0


@dataclass
class QualityModel:
    weight: np.ndarray  # per bucket: linear weight times log-count ratio
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def _word_facts(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct word: hash as it is, hash without case and outer marks, shape code."""
    texts = words.to_pylist()
    bare, shape, kinds = [], [], {}
    for w in texts:
        head = w.rstrip(MARKS)
        tail = w[len(head) :]
        low = head.lstrip(MARKS).lower()
        case = 0 if head.islower() else 1 if head.isupper() else 2 if w[:1].isupper() else 3
        bare.append(low)
        shape.append(kinds.setdefault((case, tail[:3], min(len(low), 12) // 3, low.isdigit(), len(tail) > 1), len(kinds)))
    codes = word_hashes(pa.array([repr(s) for s in kinds], pa.large_string()))
    shape_hash = codes[shape] if shape else np.zeros(0, np.uint64)
    return word_hashes(words), word_hashes(pa.array(bare, pa.large_string())), shape_hash


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bucket ids): the distinct buckets of each text."""
    off, codes, words = word_tokens(texts)
    n = len(texts)
    if not len(codes):
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    plain, bare, shape = (x[codes] for x in _word_facts(words))
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    same_doc = np.concatenate([[False], doc[1:] == doc[:-1]])
    repeat = same_doc & np.concatenate([[False], codes[1:] == codes[:-1]])
    shape = mix64(shape + repeat.astype(np.uint64))

    def joined(x: np.ndarray, size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        out, ok = x.copy(), np.ones(len(x), bool)
        for k in range(1, size):
            before = np.concatenate([np.zeros(k, x.dtype), x[:-k]])[: len(x)]
            ok &= np.concatenate([np.zeros(k, bool), doc[k:] == doc[:-k]])[: len(x)]
            out = mix64(out * np.uint64(31) + before)
        keys = (mix64(out + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int64)
        return doc[ok], keys[ok]

    parts = [joined(plain, 1, 1), joined(bare, 1, 2), joined(bare, 2, 3), joined(shape, 1, 4), joined(shape, 2, 5), joined(shape, 3, 6)]
    keys = np.concatenate([d * BUCKETS + k for d, k in parts])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) * BUCKETS), keys % BUCKETS


def margins(model: QualityModel, off: np.ndarray, ids: np.ndarray) -> np.ndarray:
    norm = _norms(model.ratio, off, ids)
    sums = np.concatenate([[0.0], np.cumsum(model.weight[ids])])
    return (sums[off[1:]] - sums[off[:-1]]) / norm + model.bias


def _norms(ratio: np.ndarray, off: np.ndarray, ids: np.ndarray) -> np.ndarray:
    squares = np.concatenate([[0.0], np.cumsum(ratio[ids] ** 2)])
    return np.sqrt(np.maximum(squares[off[1:]] - squares[off[:-1]], 1e-9))


def dual_descent(off: np.ndarray, ids: np.ndarray, values: np.ndarray, y: np.ndarray, penalty: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Linear model under the squared hinge loss by dual coordinate descent: (weights, bias)."""
    n = len(y)
    w, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(n)
    half = 0.5 / penalty
    sq = np.add.reduceat(np.append(values**2, 0.0), off[:-1]) * (np.diff(off) > 0)
    diagonal = sq + 1.0 + half
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            own, x = ids[off[i] : off[i + 1]], values[off[i] : off[i + 1]]
            gradient = y[i] * (w[own] @ x + bias) - 1 + half[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / diagonal[i])
            if (step := new - alpha[i]) != 0.0:
                alpha[i] = new
                w[own] += step * y[i] * x
                bias += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w, bias


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration by Newton steps, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(max(a, 1e-3)), float(b)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        mod: int = 5, held_out: int = 0, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> QualityModel:
    known = labels.filter(F.col(label_col).isin(0, 1) & (fold_bucket(id_col, mod) != held_out))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    # a bounded sample: the first rows of each class in the order of a hash of the id
    picked = [
        known.filter(F.col("y") == k).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(fit_rows + calibration_rows // 2)
        for k in (0, 1)
    ]
    sample = docs.select(F.col(named(id_col)).alias("id"), F.col(named(text_col)).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi in byte_slices(texts, SLICE_BYTES):
                off, ids = features(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(2)[lo:hi], lists, b.column(3)[lo:hi]], ["y", "ids", "place"])

    sample = sample.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))  # a text per id
    sample = sample.withColumn("place", F.xxhash64("id", F.lit(11)))
    got = sample.mapInArrow(sparse, "y int, ids array<int>, place bigint").toArrow().sort_by([("place", "ascending")])
    y = got["y"].to_numpy().astype(np.int64) * 2 - 1
    lists = got["ids"].combine_chunks()
    off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.concatenate([np.flatnonzero(y == k) for k in (1, -1)])
    counts = [(y == 1).sum(), (y == -1).sum()]
    if not all(counts):
        share = 0.5 if not len(y) else counts[0] / len(y)
        logit = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return QualityModel(np.zeros(BUCKETS), np.zeros(BUCKETS), logit, 1.0, 0.0)
    keep = [min(fit_rows, max(1, int(c * 2 / 3))) for c in counts]
    train = np.concatenate([order[: keep[0]], order[counts[0] : counts[0] + keep[1]]])
    rest = np.setdiff1d(order, train)

    def pick(rows_):
        lens = np.diff(off)[rows_]
        return np.concatenate([[0], np.cumsum(lens)]), ids[spread(off[rows_], lens)]

    t_off, t_ids = pick(train)
    own = np.repeat(y[train], np.diff(t_off))
    p, q = (np.bincount(t_ids[own == k], minlength=BUCKETS) + 1.0 for k in (1, -1))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[p + q == 2] = 0.0  # a bucket that no training row has says nothing
    t_values = ratio[t_ids] / np.repeat(_norms(ratio, t_off, t_ids), np.diff(t_off))
    weights = np.where(y[train] > 0, 0.5 * len(train) / keep[0], 0.5 * len(train) / keep[1]) * PENALTY
    w, bias = dual_descent(t_off, t_ids, t_values, y[train], weights)
    model = QualityModel(w * ratio, ratio, bias, 1.0, 0.0)
    check = rest if len(set(y[rest].tolist())) == 2 else train
    c_off, c_ids = pick(check)
    model.slope, model.offset = _platt(margins(model, c_off, c_ids), y[check])
    return model


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, score, predicted`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            out = np.zeros(len(texts))
            for lo, hi in byte_slices(texts, SLICE_BYTES):
                out[lo:hi] = shared.value.probability(margins(shared.value, *features(texts[lo:hi])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(named(id_col)).alias("id"), F.col(named(text_col)).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
