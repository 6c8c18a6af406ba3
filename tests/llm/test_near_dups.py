import random
import re

import numpy as np
import pytest

from claimforge.llm import near_dups
from claimforge.llm.components import connected_components
from tests.llm.helpers import DOC_SCHEMA, docs_frame


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """doc id -> (set size, component)."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for ids in where.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def _check(df, **how):
    want = brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.near_groups(df, **how).collect()}
    assert got == want
    return want


def _edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_groups_match_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = [None, "", " \n", "one two", "One  two", "a b c d", "a b c d e", "A b c d e", "a b c d f"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(60):  # a passage that many texts share
        texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(20, 90))) + " " + passage)
    for size in (60, 200, 400):
        base = [rng.choice(vocabulary) for _ in range(size)]
        texts += [_edited(rng, base, rng.randrange(0, 1 + size // 40)) for _ in range(45)]
    chain = [rng.choice(vocabulary) for _ in range(300)]
    for _ in range(12):  # each near the one before, the ends far apart
        texts.append(" ".join(chain))
        chain = _edited(rng, chain, 3).split()
    texts += ["same text over and over again " * 9] * 30 + ["z " * 30_000]
    want = _check(docs_frame(spark, texts))
    sizes = {}
    for _, c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert sum(c > 20 for c in sizes.values()) >= 3


def test_hot_list_without_links(spark):
    """Texts that agree in most coordinates but are no near copies keep their own components."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    _check(docs_frame(spark, [_edited(rng, base, 5) for _ in range(80)] + [_edited(rng, base, 2) for _ in range(10)]), chunk=7)


def test_driver_documents(spark):
    _check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_drop_and_edges(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (3, "other words"), (3, "other words"), (None, "a b c d e f"), (4, None), (5, "")]
    df = docs_frame(spark, rows).selectExpr("*", "lang AS id", "lang AS node", "lang AS sig", "n_chars AS component")
    out = near_dups.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "4", "5", "None"]
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert near_dups.near_groups(empty).count() == 0 and near_dups.drop_near_copies(empty).count() == 0


@pytest.mark.parametrize("n", [1, 40])
def test_components(spark, n):
    rng = random.Random(n)
    edges = [(i, i + 1) for i in range(0, 3 * n)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(30)] + [(500, 500 + i) for i in range(n)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert got == want
    assert np.all([c <= k for k, c in got.items()])


def test_stage_rows_that_share_an_id_and_names(spark):
    words = [f"w{k}" for k in range(60)]
    a, b = " ".join(words), " ".join(reversed(words))
    rows = [(3, a), (5, a + " tail"), (5, b), (6, b + " x"), (7, "own text"), (7, "own text"), (7, "own  TEXT"), (None, a), (None, "z"), (8, None), (8, ""), (9, " ")]
    df = docs_frame(spark, rows).selectExpr("*", "1 AS row", "2 AS `a.b`", "3 AS __gone", "4 AS __mark", "5 AS node", "6 AS id", "7 AS shared", "8 AS __hit")
    out = near_dups.drop_near_copies(df)
    assert out.columns == df.columns
    got = sorted((str(r["doc_id"]), " ".join((r["text"] or "").lower().split()), r["a.b"], r["__gone"]) for r in out.collect())
    assert got == sorted([("3", a, 2, 3), ("5", b, 2, 3), ("7", "own text", 2, 3), ("None", a, 2, 3), ("None", "z", 2, 3), ("8", "", 2, 3), ("9", "", 2, 3)])
