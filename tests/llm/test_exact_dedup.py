import hashlib
import re

from pyspark.sql import functions as F

from claimforge.llm.common import cut, split_by_keys
from claimforge.llm.exact_dedup import copy_groups, drop_copies
from tests.llm.helpers import docs_frame


def _digest(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def test_groups_match_brute_force(spark):
    texts = ["a b", "a  b", "a\tb\n", None, "", "x" * 300_000, "é b", "é b", "a\x0bb"] + ["hot copy"] * 60
    df = docs_frame(spark, texts)
    got = {r["id"]: r for r in copy_groups(df, support=0.2).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if _digest(u) == _digest(t)]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(same), len(same), i == min(same))
        assert r["digest"].hex() == _digest(t)


def test_support_does_not_change_verdicts(spark):
    df = docs_frame(spark, [f"t{i % 9}" for i in range(90)] + ["same"] * 50)
    runs = [sorted(map(tuple, copy_groups(df, support=s).select("id", "keep_id", "group_size").collect())) for s in (0.5, 0.05, 0.001)]
    assert runs[0] == runs[1] == runs[2]


def test_drop_copies_edges(spark):
    df = docs_frame(spark, [(1, "a b"), (1, "a b"), (None, "a  b"), (None, "alone"), (2, "c"), (3, "c"), (4, None), (5, "")])
    df = df.selectExpr("*", "lang AS digest", "n_chars AS keep_id", "1 AS id", "2 AS __digest", "3 AS row", "4 AS `a.b`", "5 AS heavy", "6 AS won", "7 AS __page")  # clashing names stay untouched
    out = drop_copies(df)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == [
        ("1", "a b"), ("2", "c"), ("4", None), ("None", "alone")]
    assert drop_copies(df.limit(0)).count() == 0
    assert copy_groups(df.limit(0)).count() == 0


def test_heavy_light_and_lone_texts(spark):
    texts = [f"t{i % 40}" if i < 80 else f"lone {i}" for i in range(400)] + ["hot  copy", "hot copy"] * 200
    df = docs_frame(spark, texts)
    want = sorted({_digest(t): i for i, t in reversed(list(enumerate(texts)))}.values())
    for support in (0.3, 0.001):
        assert sorted(r["doc_id"] for r in drop_copies(df, support=support).collect()) == want


def test_split_by_keys(spark):
    rows, keys = spark.range(5000), cut(spark.range(0, 5000, 9).select(F.col("id").alias("a.b")), "keys")
    sure, maybe = split_by_keys(rows, F.col("id"), keys)
    ids = {r["id"] for r in maybe.collect()}
    assert set(range(0, 5000, 9)) <= ids and len(ids) < 1200
    assert {r["id"] for r in sure.collect()} == set(range(5000)) - ids
    none, every = split_by_keys(rows, F.col("id"), keys, most_bits=100)
    assert none is None and every.count() == 5000
