"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

*Input.*  A word is the sum of a hashed embedding of its bare lower-case form and the mean of
hashed embeddings of its character n-grams (three to five characters, with the word's ends),
beside three numbers: how much the training labels speak for the word (a signed likelihood
ratio statistic over texts, capped), and the mean and maximum of the same over its n-grams.
So the network reads both characters and words.  All this, and the projection to the gates,
is computed once per distinct word of a slice.

*Network.*  Over a window of ``WINDOW`` words two gated recurrent units (one per direction,
``HIDDEN`` units each) run side by side for thousands of windows at once; attention pools
their states and a logistic unit scores the window.  Windows start every ``STRIDE`` words,
so they overlap, and cover the whole text; a text's score is that of its worst window, then
calibrated so that 0.3 separates the training rows best.

*Training.*  Backpropagation through time with Adam, on at most ``TRAIN_ROWS`` rows of each
class (the first in the order of a hash of the id).  A pass takes, per text, the windows that
score highest so far (a toxic text has clean windows, a clean text has no toxic one); before
the first pass that is their strongest word.  Only labels and texts enter; lang, source and
ids do not.

Defined results: null and empty texts are one window of padding; without labels of both
classes every score is 0 (nothing can be called toxic) or, if only label 1 is known, 1; of rows
that repeat a labelled id the least text trains, and every row is scored; a text without white
space is one word; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from claimforge.llm.common import byte_slices, char_codes, fold_bucket, mix64, named, release, spread, texts_of, word_tokens

WINDOW = 48
STRIDE = 36
HIDDEN = 8
WORD_ROWS = 1 << 14
CHAR_ROWS = 1 << 14
WIDTH = 8
FACTS = 3  # numbers beside the embedding
INPUT = WIDTH + FACTS
TRAIN_ROWS = 1200
SLICE_BYTES = 2 << 20
BLOCK = 2048  # windows worked at once
THRESHOLD = 0.3
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_inputs(words: pa.Array, block: int = 16_384) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word row, n-gram rows one after another, n-gram offsets) of each distinct word, some words at a time."""
    parts = [_word_inputs(words[lo : lo + block]) for lo in range(0, max(1, len(words)), block)]
    sizes = np.concatenate([np.diff(p[2]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum(sizes)])


def _word_inputs(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bare = pa.array([w.strip(MARKS).lower() for w in words.to_pylist()], pa.large_string())
    chars, off = char_codes(bare)
    lens = np.diff(off)
    padded_lens = lens + 2  # with both ends marked
    poff = np.concatenate([[0], np.cumsum(padded_lens)])
    padded = np.zeros(int(poff[-1]), np.uint64)
    padded[poff[:-1]], padded[poff[1:] - 1] = 2, 3
    padded[spread(poff[:-1] + 1, lens)] = chars.astype(np.uint64)
    word = np.repeat(np.arange(len(lens)), padded_lens)
    rows, owner = [], []
    rolled = mix64(padded)
    for size in (2, 3, 4, 5):
        n = len(padded) - size + 1
        if n <= 0:
            break
        rolled = mix64(rolled[:n] * np.uint64(31) + padded[size - 1 :])
        inside = word[:n] == word[size - 1 :]
        if size > 2:
            rows.append((rolled[inside] % np.uint64(CHAR_ROWS)).astype(np.int32))
            owner.append(word[:n][inside])
    rows, owner = np.concatenate([*rows, np.zeros(0, np.int32)]), np.concatenate([*owner, np.zeros(0, np.int64)])
    order = np.argsort(owner, kind="stable")
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(padded + np.arange(len(padded), dtype=np.uint64) - np.repeat(poff[:-1], padded_lens).astype(np.uint64) * np.uint64(1)))])
    key = sums[poff[1:]] - sums[poff[:-1]]  # a hash of the characters with their places
    return (mix64(key) % np.uint64(WORD_ROWS)).astype(np.int64) + 1, rows[order], np.searchsorted(owner[order], np.arange(len(lens) + 1))


def windows(off: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, length, text) of all overlapping windows; a text without words has one of length 0."""
    size = np.diff(off)
    count = np.maximum(1, -(-(size - (window - stride)) // stride))
    text = np.repeat(np.arange(len(size)), count)
    turn = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = turn * stride
    return off[:-1][text] + start, np.minimum(window, size[text] - start), text


@dataclass
class Network:
    """Weights; the gates of a direction are ordered update, reset, candidate."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    word_fact: np.ndarray | None = None
    char_fact: np.ndarray | None = None
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    @classmethod
    def start(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {
            "word": np.zeros((WORD_ROWS + 1, WIDTH), np.float32),
            "char": (0.05 * rng.normal(size=(CHAR_ROWS, WIDTH))).astype(np.float32),
            "v": draw(HIDDEN),
            "a": draw(2 * HIDDEN, HIDDEN),
            "out": draw(2 * HIDDEN),
            "b": np.zeros(1, np.float32),
        }
        for d in "fb":
            p["w" + d], p["u" + d], p["c" + d] = draw(INPUT, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
        return cls(p)

    def embed(self, word: np.ndarray, grams: np.ndarray, gram_off: np.ndarray) -> np.ndarray:
        """Input vector of each distinct word, with the padding vector 0 in front."""
        out = np.zeros((len(word) + 1, INPUT), np.float32)
        table = np.column_stack([self.p["char"], self.char_fact])
        for lo in range(0, len(word), 20_000):
            hi = min(len(word), lo + 20_000)
            a, b = gram_off[lo], gram_off[hi]
            size = np.diff(gram_off[lo : hi + 1])
            rows = np.concatenate([table[grams[a:b]], np.zeros((1, WIDTH + 1), np.float32)])
            heads, some = gram_off[lo:hi] - a, size > 0
            means = np.add.reduceat(rows, heads) * some[:, None] / np.maximum(size, 1)[:, None]
            own = out[lo + 1 : hi + 1]
            own[:, :WIDTH] = means[:, :WIDTH] + self.p["word"][word[lo:hi]]
            own[:, WIDTH] = self.word_fact[word[lo:hi]]
            own[:, WIDTH + 1] = means[:, WIDTH]
            rows[-1, WIDTH] = -np.inf  # so that the last word's maximum is its own
            own[:, WIDTH + 2] = np.where(some, np.maximum.reduceat(rows[:, WIDTH], heads), 0)
        return out

    def run(self, x: np.ndarray, tokens: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logit of each window.  x: input vectors, tokens: (windows, steps) rows of x, 0 after the end."""
        p, (n, steps) = self.p, tokens.shape
        full = bool((length >= steps).all())
        states = np.zeros((2, steps, n, HIDDEN), np.float32)
        trace = {"f": [], "b": []}
        for k, d in enumerate("fb"):
            gates = x @ p["w" + d] + p["c" + d]
            h = np.zeros((n, HIDDEN), np.float32)
            u = p["u" + d]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                g = gates[tokens[:, t]]
                uh = h @ u
                zr = g[:, : 2 * HIDDEN] + uh[:, : 2 * HIDDEN]
                zr = 0.5 * np.tanh(0.5 * zr) + 0.5
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * uh[:, 2 * HIDDEN :])
                live = None if full else (t < length)[:, None]
                new = h + z * (c - h) if full else np.where(live, h + z * (c - h), h)
                if keep:
                    trace[d].append((t, h, z, r, c, uh[:, 2 * HIDDEN :], live))
                h = new
                states[k, t] = h
        both = np.concatenate([states[0], states[1]], axis=2)  # (steps, windows, 2 * HIDDEN)
        hidden = np.tanh(both @ p["a"])
        weight = hidden @ p["v"]
        if not full:
            seen = np.arange(steps)[:, None] < np.maximum(length, 1)[None, :]
            weight = np.where(seen, weight, np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * both).sum(axis=0)
        logit = pooled @ p["out"] + p["b"][0]
        return (logit, (trace, both, hidden, weight, pooled)) if keep else logit

    def gradients(self, x: np.ndarray, tokens: np.ndarray, length: np.ndarray, y: np.ndarray, share: np.ndarray):
        """Loss and gradients of all weights but the embeddings, and the gradient of x."""
        p = self.p
        logit, (trace, both, hidden, weight, pooled) = self.run(x, tokens, length, keep=True)
        prob = 0.5 * np.tanh(0.5 * logit) + 0.5
        loss = float((share * (np.logaddexp(0, logit) - y * logit)).sum())
        d_logit = (share * (prob - y)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        g["out"], g["b"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * p["out"]
        d_both = weight[:, :, None] * d_pooled
        d_weight = (both * d_pooled).sum(axis=2)
        d_weight = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.einsum("tn,tnh->h", d_weight, hidden)
        d_hidden = d_weight[:, :, None] * p["v"] * (1 - hidden**2)
        g["a"] = np.tensordot(both, d_hidden, axes=([0, 1], [0, 1]))
        d_both = d_both + d_hidden @ p["a"].T
        dx = np.zeros_like(x)
        order = np.argsort(tokens.T.ravel(), kind="stable")
        used, first = np.unique(tokens.T.ravel()[order], return_index=True)
        for k, d in enumerate("fb"):
            d_states = d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dh = np.zeros((tokens.shape[0], HIDDEN), np.float32)
            gates = np.zeros((tokens.shape[1], tokens.shape[0], 3 * HIDDEN), np.float32)
            for t, h, z, r, c, uc, live in reversed(trace[d]):
                dh = dh + d_states[t]
                step = dh if live is None else np.where(live, dh, 0)
                dc = step * z * (1 - c**2)
                dz = step * (c - h) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                gates[t] = np.concatenate([dz, dr, dc], axis=1)
                inner = np.concatenate([dz, dr, dc * r], axis=1)
                g["u" + d] += h.T @ inner
                dh = (step * (1 - z) if live is None else np.where(live, step * (1 - z), dh)) + inner @ p["u" + d].T
            d_gates = np.zeros((len(x), 3 * HIDDEN), np.float32)
            d_gates[used] = np.add.reduceat(gates.reshape(-1, 3 * HIDDEN)[order], first)
            g["c" + d], g["w" + d] = d_gates.sum(axis=0), x.T @ d_gates
            dx += d_gates @ p["w" + d].T
        return loss, g, dx, logit

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(logit, text) of every window of every text."""
        off, codes, words = word_tokens(texts)
        x = self.embed(*word_inputs(words)) if len(words) else np.zeros((1, INPUT), np.float32)
        start, length, text = windows(off)
        return self.window_logits(x, codes, start, length), text

    def window_logits(self, x: np.ndarray, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logit of each window; windows of one length are worked together."""
        logit, order = np.zeros(len(start), np.float32), np.argsort(-length, kind="stable")
        whole = int((length == WINDOW).sum())
        for lo, hi in [*_ranges(0, whole), *_ranges(whole, len(start))]:
            part = order[lo:hi]
            logit[part] = self.run(x, _tokens(codes, start[part], length[part]), length[part])
        return logit

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.constant is not None:
            return out + self.constant
        for lo, hi in byte_slices(texts, SLICE_BYTES):
            logit, text = self.logits(texts[lo:hi])
            worst = np.maximum.reduceat(logit, np.searchsorted(text, np.arange(hi - lo))).astype(np.float64)
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -500, 500)))
        return out


def _ranges(lo: int, hi: int) -> list[tuple[int, int]]:
    return [(a, min(hi, a + BLOCK)) for a in range(lo, hi, BLOCK)]


def _tokens(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(windows, steps) rows of the input vectors, 0 after a window's end."""
    steps = max(1, int(length.max(initial=0)))
    at = start[:, None] + np.arange(steps)
    inside = np.arange(steps) < length[:, None]
    return np.where(inside, codes[np.minimum(at, max(0, len(codes) - 1))] + 1, 0) if len(codes) else np.zeros((len(start), steps), np.int64)


def _sum_rows(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of the values of each row number."""
    return np.column_stack([np.bincount(rows, weights=values[:, j], minlength=size) for j in range(values.shape[1])]).astype(np.float32)


def count_labels(off, codes, word, grams, gram_off, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of texts of each group that have a word row, and an n-gram row: (groups, rows) each, some texts at a time."""
    words, chars = np.zeros((groups, WORD_ROWS + 1)), np.zeros((groups, CHAR_ROWS))
    size = np.diff(gram_off)
    for lo in range(0, len(off) - 1, 64):
        hi = min(len(off) - 1, lo + 64)
        doc = np.repeat(np.arange(lo, hi, dtype=np.int64), np.diff(off[lo : hi + 1]))
        own = np.unique(doc * np.int64(len(word) + 1) + codes[off[lo] : off[hi]])
        doc, code = own // (len(word) + 1), own % (len(word) + 1)
        for rows, of, table in ((word[code], doc, words), (grams[spread(gram_off[code], size[code])], np.repeat(doc, size[code]), chars)):
            seen = np.unique(of * np.int64(table.shape[1]) + rows)
            at = group[seen // table.shape[1]] * table.shape[1] + seen % table.shape[1]
            table += np.bincount(at, minlength=table.size).reshape(table.shape)
    return words, chars


def label_facts(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Per row: signed likelihood-ratio statistic of its texts' labels against the overall share, in units of 20, at most 3."""
    n, share = pos + neg, min(max(n_pos / max(1, n_pos + n_neg), 1e-6), 1 - 1e-6)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(pos > 0, pos * np.log(pos / (n * share)), 0) + np.where(neg > 0, neg * np.log(neg / (n * (1 - share))), 0))
    return np.clip(np.where(pos * max(1, n_neg) >= neg * max(1, n_pos), g, -g) / 20, -3, 3).astype(np.float32)


def train(texts: list[str], y: np.ndarray, passes: int = 3, batch: int = 256, rate: float = 0.01, most_steps: int = 270, seed: int = 0) -> Network:
    """Fit the network to labelled texts (see the module's notes)."""
    net, rng = Network.start(seed), np.random.default_rng(seed)
    off, codes, words = word_tokens(pa.array(texts, pa.large_string()))
    word, grams, gram_off = word_inputs(words)
    start, length, text = windows(off)
    label = y[text].astype(np.float32)
    fold = np.zeros(len(texts), np.int64)  # a text is trained with facts from the other half of the texts
    for k in (0, 1):
        fold[np.flatnonzero(y == k)[1::2]] = 1

    counts = count_labels(off, codes, word, grams, gram_off, 2 * fold + y, 4)
    rows_of = np.bincount(2 * fold + y, minlength=4)

    def facts(folds: list[int]):
        """Word and n-gram facts from the labels of some folds."""
        neg, pos = ([2 * f + k for f in folds] for k in (0, 1))
        return [label_facts(t[pos].sum(axis=0), t[neg].sum(axis=0), rows_of[pos].sum(), rows_of[neg].sum()) for t in counts]

    crossed = [facts([1 - k]) for k in (0, 1)]

    def use(k: int):
        net.word_fact, net.char_fact = crossed[k]

    def all_logits() -> np.ndarray:
        logit = np.zeros(len(start), np.float32)
        for k in (0, 1):
            use(k)
            own = fold[text] == k
            logit[own] = net.window_logits(net.embed(word, grams, gram_off), codes, start[own], length[own])
        return logit

    own_windows = np.bincount(text, minlength=len(texts))
    texts_of_class = np.array([max(1, (y == k).sum()) for k in (0, 1)])
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    steps = 0

    def step(pick: np.ndarray, share: np.ndarray):
        nonlocal steps
        steps += 1
        tokens = _tokens(codes, start[pick], length[pick])
        used, local = np.unique(tokens[tokens > 0] - 1, return_inverse=True)
        rows = np.zeros_like(tokens)
        rows[tokens > 0] = local + 1
        size = np.diff(gram_off)[used]
        own = grams[spread(gram_off[used], size)]
        own_off = np.concatenate([[0], np.cumsum(size)])
        x = net.embed(word[used], own, own_off)
        _, g, dx, _ = net.gradients(x, rows, length[pick], label[pick], share)
        dx = dx[1:, :WIDTH]  # the facts are fixed
        g["word"] = _sum_rows(word[used], dx, WORD_ROWS + 1)
        g["char"] = _sum_rows(own, np.repeat(dx / np.maximum(size, 1)[:, None], size, axis=0), CHAR_ROWS)
        now = rate * min(1.0, steps / 20) * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
        for k, v in net.p.items():
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
            v -= now * m[k] / (np.sqrt(s[k]) + 1e-8)
            if k in ("word", "char"):
                v *= 1 - 1e-3

    for turn in range(passes):
        if turn == 0:
            logit = np.zeros(len(start))
            for k in (0, 1):
                use(k)
                x = net.embed(word, grams, gram_off)
                strong = np.concatenate([x[1:, WIDTH:].sum(axis=1)[codes], [0.0]])
                for i in np.flatnonzero(fold[text] == k):
                    logit[i] = strong[start[i] : start[i] + max(1, length[i])].max()
        else:
            logit = all_logits()
        order = np.lexsort((-logit, text))
        place = np.arange(len(order)) - np.repeat(np.cumsum(own_windows) - own_windows, own_windows)
        most = np.where(label[order] > 0, 1, 1 + own_windows[text[order]] // 4)
        chosen = rng.permutation(order[place < most])
        weight = np.array([1.0 / max(1, (label[chosen] == k).sum()) for k in (0, 1)]) * len(chosen) / 2
        while steps < most_steps * (turn + 1) // passes:  # every pass has its share of the steps
            picks = [(k, own[lo : lo + batch]) for k in (0, 1) for own in [chosen[fold[text[chosen]] == k]] for lo in range(0, len(own), batch)]
            for at in rng.permutation(len(picks)):
                k, pick = picks[at]
                use(k)
                step(pick, (weight[label[pick].astype(np.int64)] / len(pick)).astype(np.float32))
                if steps >= most_steps * (turn + 1) // passes:
                    break
            chosen = rng.permutation(chosen)
    worst = np.maximum.reduceat(all_logits(), np.searchsorted(text, np.arange(len(texts)))).astype(np.float64)
    net.slope, net.offset = _calibrate(worst, y, texts_of_class)
    net.word_fact, net.char_fact = facts([0, 1])
    return net


def _calibrate(worst: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[float, float]:
    """Put the cut with the fewest weighted errors, high in its gap, at THRESHOLD."""
    order = np.argsort(worst)
    w, lab = worst[order], y[order]
    missed = np.concatenate([[0], np.cumsum(lab)]) / sizes[1]  # toxic texts below the cut
    false = (sizes[0] - np.concatenate([[0], np.cumsum(1 - lab)])) / sizes[0]
    cost = missed + 2 * false  # a clean text that goes is the worse error
    edges = np.concatenate([[w[0] - 1], w, [w[-1] + 1]])
    gap = edges[1:] - edges[:-1]
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = best[np.argmax(gap[best])]
    cut = edges[k] + (edges[k + 1] - edges[k]) * 0.7
    return 1.0, float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        mod: int = 4, held_out: int = 2, rows: int = TRAIN_ROWS) -> Network:
    known = labels.filter(F.col(label_col).isin(0, 1) & (fold_bucket(id_col, mod) != held_out))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    here = docs.select(F.col(named(id_col)).alias("id"), F.col(named(text_col)).alias("text"))
    place = F.xxhash64("id", F.lit(5))
    picked = [known.filter(F.col("y") == k).orderBy(place, "id").limit(rows) for k in (0, 1)]
    sample = here.join(F.broadcast(picked[0].unionByName(picked[1])), "id")  # at most 2 * rows ids
    got = sample.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("id").toArrow()  # a text per id
    texts, y = pc.fill_null(got["text"], "").to_pylist(), got["y"].to_numpy().astype(np.int64)
    del got
    if len(set(y.tolist())) < 2:
        return Network(constant=float(len(y) > 0 and y[0] == 1))
    net = train(texts, y)
    del texts
    gc.collect()
    release()  # the driver goes on without what the training took
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, predicted`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(texts_of(b.column(1))))], ["id", "score"])
            release()

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(named(id_col)).alias("id"), F.col(named(text_col)).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows that are not called toxic, with their own columns; no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(texts_of(b.column(at))) < THRESHOLD))
            release()

    return docs.mapInArrow(run, docs.schema)
