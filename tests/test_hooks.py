"""User hooks (J1-J3), the length filter, and the plan of the grouped selection."""

from pyspark.sql import functions as F

from claimforge.functions.draws import hash_key
from claimforge.operators import hooks as H
from claimforge.operators.sampling import take_first


def test_batch_and_group_hooks(spark):
    df = spark.createDataFrame([(i, f"w{i} " * (i % 3)) for i in range(10)], "id long, text string")
    twice = H.flat_map_batches(df, lambda b: b.loc[b.index.repeat(2)], df.schema)
    assert twice.count() == 20
    sized = H.map_rows(df, lambda b: b.text.str.len(), "size", "long")
    assert {r["id"]: r["size"] for r in sized.collect()} == {i: len(f"w{i} " * (i % 3)) for i in range(10)}
    assert [r["id"] for r in H.filter_rows(df, lambda b: b.id > 7).orderBy("id").collect()] == [8, 9]
    got = H.aggregate_groups(df.withColumn("k", F.col("id") % 2), ["k"], lambda v: v.median(), "id", "m").collect()
    assert {r["k"]: r["m"] for r in got} == {0: 4.0, 1: 5.0}


def test_length_filter_with_own_counter(spark):
    df = spark.createDataFrame([("a b c",), ("a",), ("",)], "text string")
    assert H.max_token_filter(df, "text", 3).count() == 2
    assert H.max_token_filter(df, "text", 3, lambda c: F.length(c)).count() == 2


def test_grouped_selection_cuts_before_any_exchange(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = take_first(docs, hash_key(1, "x", "doc_id"), ["doc_id"], 5, ["lang"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert got.groupBy("lang").count().filter("count <> 5").count() == 0
