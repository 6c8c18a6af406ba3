import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from claimforge.llm import katz
from tests.llm.helpers import DOC_SCHEMA, docs_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")] + ["</s>"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def model(rows):
    """(unigram counts, P(token | before)) by plain dictionaries."""
    uni, pairs = Counter(), defaultdict(Counter)
    for i, text in rows:
        if not held(i):
            t = tokens(text)
            uni.update(t)
            for a, b in zip(["<s>", *t], t):
                pairs[a][b] += 1

    def gt(counters):
        n = Counter(c for counts in counters for c in counts.values())
        try:
            a = 6 * n[6] / n[1]
            d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, 6)}
            if all(0 < x < 1 for x in d.values()):
                return d
        except ZeroDivisionError:
            pass
        return {r: 1 - 0.5 / r for r in range(1, 6)}

    def level(counts, d):
        left = sum((1 - d.get(c, 1)) * c for c in counts.values())
        total = sum(counts.values())
        if left <= 0:
            left, total = 1, total + 1
        return {w: d.get(c, 1) * c / total for w, c in counts.items()}, left / total

    d2 = gt(pairs.values())
    one, unknown = level(uni, gt([uni]))
    after = {h: level(c, d2) for h, c in pairs.items()}
    rest = {h: max(1 - sum(one[w] for w in c), unknown) for h, c in pairs.items()}

    def p(w, h):
        if h not in after:
            return one.get(w, unknown)
        seen, left = after[h]
        return seen[w] if w in seen else left / rest[h] * one.get(w, unknown)

    return uni, p


def brute(rows):
    uni, p = model(rows)
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, text in rows:
        t = tokens(text)
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out.append((i, held(i), len(t), sum(uni[w] > 0 for w in t), n, base, sum(math.log10(p(w, h)) for h, w in zip(["<s>", *t], t))))
    return out


def _texts(seed, n, size=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5))) for _ in range(size)]
    weight = [1 / (k + 1) for k in range(size)]
    out = [" ".join(rng.choices(words, weight)[0] if rng.random() < 0.97 else f"new{rng.random()}" for _ in range(rng.randrange(0, 40))) for _ in range(n)]
    return [*out, None, "", "  \n", "A b\tÉ\x0bC\x85d", out[3], out[3].upper(), "the the " * 4000, "unbroken" * 3000]


def _same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-11, atol=1e-9)


@pytest.mark.parametrize("more", [{}, {"chunk_bytes": 900, "words_a_part": 40, "tokens_a_part": 500, "split": 60}])
def test_against_dictionaries(spark, more):
    """One chunk and part, and many of both with contexts dealt over several parts."""
    texts = _texts(1, 500)
    rows = list(enumerate(texts)) + [(None, "a b c"), (7, "b a"), (7, "b a")]
    df = docs_frame(spark, rows).repartition(2)
    _same(katz.score(df, **more).collect(), brute(rows))


def test_a_corpus_that_needs_the_other_discounts(spark):
    rows = list(enumerate(["a b a b a b", "a b", "c", None, "b a b", "x y z", "a a a a a a a b"]))
    _same(katz.score(docs_frame(spark, rows)).collect(), brute(rows))


def test_probabilities_add_up_to_one():
    uni, p = model(list(enumerate(_texts(5, 200, 40))))
    for h in ["<s>", *list(uni)[:60], "never"]:
        assert abs(sum(p(w, h) for w in uni) + p("never", h) - 1) < 1e-9 or h == "</s>"


def test_beats_the_base_on_held_out_texts(spark):
    got = katz.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("held_out").collect()
    assert got and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_empty_nothing_to_learn_more_columns(spark):
    df = docs_frame(spark, _texts(2, 40))
    assert katz.score(df.limit(0)).count() == 0
    only = next(i for i in range(1000) if held(i))
    got = katz.score(spark.createDataFrame([(only, "a b", "en", "s", 3)], DOC_SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(only, True, 3, 0, 0, 0.0, 0.0)]
    odd = df.selectExpr("*", "1 as chunk", "2 as part", "3 as block", "4 as `a.b`", "5 as score", "6 as h")
    assert sorted(map(tuple, katz.score(odd).collect())) == sorted(map(tuple, katz.score(df).collect()))


def test_blocks():
    rng = np.random.default_rng(1)
    arrays = [np.array([], np.int64), np.array([0, 0]), rng.integers(0, 2**62, 50), np.array([2**63 - 1]), rng.integers(0, 300, 1000)]
    assert all(np.array_equal(a, b) for a, b in zip(arrays, katz.unpack(katz.pack(*arrays))))
    words = pa.array(["", "é", "a\x00", "😀" * 9], pa.large_string())
    assert katz.unpack_words(katz.pack_words(words)).to_pylist() == words.to_pylist()
