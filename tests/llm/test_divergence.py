import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimforge.llm import divergence
from tests.llm.helpers import DOC_SCHEMA

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top):
    docs, own, lang_n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        lang, source = lang or "", source or ""
        docs[lang].update(set(terms))
        own[lang, source].update(terms)
        lang_n[lang].update(terms)
    out = set()
    for (lang, source), counts in own.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        v = len(kept)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept}

        p, q = shares(counts), shares(lang_n[lang])
        terms = sorted(((q[t] - p[t], t.encode()) for t in kept if counts[t] > 0 and p[t] > q[t]))[:top]
        out |= {(lang, source, "term", t.decode(), -d, k + 1) for k, (d, t) in enumerate(terms)}
        pairs = []
        for (lang2, other), c2 in own.items():
            if lang2 == lang and other != source:
                p2 = shares(c2)
                pairs.append((-sum(abs(p[t] - p2[t]) for t in kept), other.encode()))
        out |= {(lang, source, "pair", s.decode(), -d, k + 1) for k, (d, s) in enumerate(sorted(pairs))}
    return out


def _rows(seed, n, sources):
    rng = random.Random(seed)
    words = ["the", "The", "été", "straße", "Ünder", "a1b", "x_y", "don't", "中文 字", "é", "Z", "z\x7fz", "\x85k", "[q]"] + ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    rows = []
    for k in range(n):
        source = rng.choice([None, "", "hot", "hot", *sources])
        text = None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
        rows.append((k % (n - 3), text, rng.choice(["en", "en", "de", None, "xx"] if k else ["one"]), source, 0))
    return [*rows, (9, "", "lonely", "a", 0), (9, "the " * 50_000, "en", "hot", 0), rows[5], rows[5]]


def _got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = _rows(seed, 400, ["a", "b", "ä", "B", "zz"])
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    want = brute([r[1:4] for r in rows], 8, 5)
    assert {r[2] for r in want} == {"term", "pair"}
    assert _got(divergence.audit(df, min_docs=8, top=5)) == want


def test_more_sources_than_a_block(spark):
    """Blocks of two sources, matrices of three terms, sums handed on early: the same result."""
    rows = _rows(3, 300, list("abcdefgh"))
    df = spark.createDataFrame(rows, DOC_SCHEMA).select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    raw = divergence.term_counts(df, most=40).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    assert sorted(map(tuple, raw.collect())) == sorted(tuple(r) for r in divergence.term_counts(df).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # terms go on over batches
    try:
        kept = divergence.cut(divergence.kept_terms(df, 6), "kept")
        got = _got(divergence.pair_sums(kept, divergence.group_table(df, kept), size=2, salts=2, most=3))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r for r in brute([r[1:4] for r in rows], 6, 7) if r[2] == "pair"}


def test_large_counts_are_exact(spark):
    n, total = 9 * 10**14 + 7, 10**16 + 3
    got = spark.createDataFrame([(n, total, 11)], "n long, t long, v long").select(divergence.share("n", "t", "v")).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 55)


def test_empty_table_clashing_names(spark):
    df = spark.createDataFrame(_rows(4, 60, ["a"]), DOC_SCHEMA)
    assert divergence.audit(df.limit(0)).count() == 0
    odd = df.selectExpr("*", "1 as n", "2 as term", "3 as idx", "4 as `a.b`", "5 as total", "6 as V", "7 as item")
    assert _got(divergence.audit(odd, min_docs=3)) == _got(divergence.audit(df, min_docs=3))


def test_only_terms_of_a_slice():
    import pyarrow as pa

    texts = pa.array(["skip", "A\x00b é[c]", "", "Ωx1"], pa.large_string())
    assert divergence.only_terms(texts[1:]).to_pylist() == ["A b é c ", "", "Ωx "]
    assert divergence.only_terms(texts[:0]).to_pylist() == []
    assert np.array_equal(divergence.slice_sums(np.zeros(0, int), texts[:0])[0], [])
