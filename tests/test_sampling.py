"""Sampling operators: exact sizes, strata, bootstrap, partition independence, plan shape."""

import math
import random

import pytest
from pyspark.sql import functions as F

from claimforge.functions.draws import hash_key, py_hash_key
from claimforge.operators import sampling as S


def _ref_take_first(rows, quota, seed, salt):
    """Brute force: first `quota` rows per group in (md5, id) order."""
    out = []
    groups = {}
    for g, i in rows:
        groups.setdefault(g, []).append(i)
    for g, ids in groups.items():
        ids = sorted(ids, key=lambda i: (py_hash_key(seed, salt, i), i))
        q = quota[g] if isinstance(quota, dict) else quota
        out += [(g, i) for i in ids[:q]]
    return sorted(out)


def test_take_first_matches_brute_force_on_skewed_groups(spark):
    rnd = random.Random(7)
    # one group holds most rows (hot key), others are tiny
    rows = [("hot", i) for i in range(3000)] + [(f"g{rnd.randint(0, 9)}", 10000 + i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id long")
    quota = {g: (137 if g == "hot" else 7) for g, _ in rows}
    qdf = spark.createDataFrame(list(quota.items()), "g string, quota long")
    got = S.take_first(df, hash_key(42, "t", "id"), ["id"], qdf, ["g"])
    assert sorted((r["g"], r["id"]) for r in got.collect()) == _ref_take_first(rows, quota, 42, "t")


def test_take_first_same_under_any_partitioning(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 3)
    res = []
    for parts in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        d = df.repartition(parts)
        res.append(sorted(r["id"] for r in S.take_first(d, hash_key(1, "p", "id"), ["id"], 500, ["g"]).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1] == res[2] and len(res[0]) == 1500


def test_dense_rank_is_a_permutation(spark):
    df = spark.range(2500)
    r = S.dense_rank(df, hash_key(3, "r", "id"), ["id"], name="rk").collect()
    assert sorted(x["rk"] for x in r) == list(range(2500))
    order = sorted(range(2500), key=lambda i: (py_hash_key(3, "r", i), i))
    assert {x["id"]: x["rk"] for x in r} == {i: k for k, i in enumerate(order)}


@pytest.mark.parametrize("n_rows", [99, 100, 101])
def test_resize_to_n_boundary(spark, n_rows):
    df = spark.range(n_rows)
    out = S.resize_to_n(df, 100, 42, "rs")
    rows = out.collect()
    assert len(rows) == 100
    ids = [r["id"] for r in rows]
    if n_rows > 100:  # subsample: distinct rows
        assert len(set(ids)) == 100
    else:  # bootstrap: sample_idx 0..n-1, duplicates allowed
        assert sorted(r["sample_idx"] for r in rows) == list(range(100))


def test_resize_empty_raises(spark):
    with pytest.raises(ValueError):
        S.resize_to_n(spark.range(0), 10, 42, "rs")


def test_stratified_quotas_largest_remainder(spark):
    # 10 rows: 7 of class 1, 3 of class 0; k=5 -> exact 3.5 / 1.5 -> tie in remainder -> smaller label first
    rows = [(i, 1) for i in range(7)] + [(100 + i, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, y int")
    out = S.stratified_exact(df, 5, 42, "st", ["id"], "y").collect()
    ys = sorted(r["y"] for r in out)
    assert len(out) == 5 and ys.count(0) == 2 and ys.count(1) == 3


def test_stratified_one_row_stratum_and_oversize(spark):
    rows = [(i, 1) for i in range(9)] + [(100, 0)]
    df = spark.createDataFrame(rows, "id long, y int")
    assert S.stratified_exact(df, 1000, 42, "st", ["id"], "y").count() == 10
    out = S.stratified_exact(df, 4, 42, "st", ["id"], "y").collect()
    assert len(out) == 4  # shares 3.6 / 0.4: floors 3 / 0, the leftover goes to the larger remainder (0.6)
    assert sorted(r["y"] for r in out) == [1, 1, 1, 1]
    out = S.stratified_exact(df, 5, 42, "st", ["id"], "y").collect()  # 4.5 / 0.5: tie -> smaller label
    assert sorted(r["y"] for r in out) == [0, 1, 1, 1, 1]


def test_stratified_within_one_of_proportional(spark):
    df = spark.range(10000).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    out = S.stratified_exact(df, 1234, 5, "st", ["id"], "y").groupBy("y").count().collect()
    got = {r["y"]: r["count"] for r in out}
    n1 = df.filter("y = 1").count()
    assert sum(got.values()) == 1234
    assert abs(got[1] - 1234 * n1 / 10000) <= 1


def test_train_val_split_grouped_has_no_leak(spark):
    df = spark.range(2000).select("id", (F.col("id") % 300).alias("src"))
    train, test = S.train_val_split(df, 0.1, 42, "tv", ["id"], group="src")
    tr = {r["src"] for r in train.select("src").distinct().collect()}
    te = {r["src"] for r in test.select("src").distinct().collect()}
    assert not (tr & te) and len(te) == math.ceil(0.1 * 300)


def test_take_first_plan_windows_by_group_and_bucket(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    plan = S.take_first(df, hash_key(1, "p", "id"), ["id"], 10, ["g"])._jdf.queryExecution().executedPlan().toString()
    # the data-sized window is hash-partitioned by (group, bucket), never a single partition
    assert "hashpartitioning(g#" in plan and "_cf_b" in plan


def test_split_flag_is_the_head_of_the_order(spark):
    df = spark.range(3000).select("id", (F.col("id") % 10).alias("k")).repartition(5)
    order = hash_key(9, "x", "id")
    for share in (0.0, 0.001, 0.1, 1.0):
        flagged = S.split_flag(df, share, 9, "x", ["id"])
        n = math.ceil(round(3000 * share, 9))
        want = [r["id"] for r in df.orderBy(order, "id").limit(n).collect()]
        assert sorted(r["id"] for r in flagged.filter("is_test").collect()) == sorted(want)
        assert "Join" not in flagged._jdf.queryExecution().optimizedPlan().toString()
    assert S.split_flag(df.limit(0), 0.5, 9, "x", ["id"]).count() == 0


def test_folds_have_exact_sizes_and_whole_groups(spark):
    df = spark.range(1003).select("id", (F.col("id") % 57).alias("g"))
    sizes = {r["fold"]: r["count"] for r in S.fold_of(df, [0.2, 0.3], 1, "f", ["id"]).groupBy("fold").count().collect()}
    assert sizes == {0: 201, 1: 502 - 201, 2: 501}
    folds = S.fold_of(df, [0.25, 0.25, 0.25], 1, "f", ["id"], group="g").select("g", "fold").distinct().collect()
    assert len(folds) == 57 and sorted({r["fold"] for r in folds}) == [0, 1, 2, 3]


def test_few_shot_sets_match_single_draws(spark):
    df = spark.range(400).select("id", (F.col("id") % 5 == 0).cast("int").alias("label"))
    sets = S.few_shot_sets(df, [10, 64, 500], 3, "fs")
    for shot, n in ((10, 10), (64, 64), (500, 398)):
        want = sorted(map(tuple, S.stratified_exact(df, n, 3, "fs", ["id"], "label").select("id", "label").collect()))
        assert sorted(map(tuple, sets.filter(F.col("shot") == shot).drop("shot").collect())) == want
