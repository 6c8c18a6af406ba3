"""Source and sink queries (A1-A6, A8) and the fitted scorer (F2).

Sinks write below the shared checkpoint folder; each query writes a fresh folder
and reads it back, so the returned rows are what a later reader would see.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from claimforge.operators import sampling as S
from claimforge.operators import scoring as SCR
from claimforge.operators.corpus import build_corpus
from claimforge.operators.hooks import max_token_filter
from claimforge.plans.base import N, PPC, SEED, SPC, V, register
from claimforge.plans.q_eval import _eval_long, eval_ctes
from claimforge.plans.q_runs import MAX_TOKENS, MS, R6, RES_COLS, RUN_DATASETS, r6, results, rsql
from claimforge.plans.sqlviews import sql_hash, with_ctes
from claimforge.session import materialize, scratch_path
from claimforge.sources import results as IO
from claimforge.sources.tables import declare, load_splits, source, split_of, with_class_names

register("scan_split", "select doc_id, lang, n_chars from documents where lang = 'en'")(
    lambda s, r: split_of(source(s, r, "documents"), "en", "lang").select("doc_id", "lang", "n_chars")
)


LANGUAGES = ["de", "en", "es", "fr"]


def _a1_splits(s, r):
    """Two of three splits of a table that is written by split, its schema checked, labels named."""
    base = scratch_path(s, "splits")
    docs = source(s, r, "documents")
    label = F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), F.coalesce("lang", F.lit(""))).cast("int") - 1
    third = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    shaped = docs.select(F.struct("doc_id", "source").alias("origin"), F.length("text").alias("size"), label.alias("label"), third.alias("split"))
    shaped.write.partitionBy("split").parquet(f"{base}/by_language.parquet")
    declare("by_language", "origin struct<doc_id: bigint, source: string>, size int, label int", {"label": LANGUAGES})
    got = with_class_names(load_splits(s, base, "by_language", ["train", "test"]), "by_language")
    return got.select(F.col("origin.doc_id").alias("doc_id"), F.col("origin.source").alias("source"), "size", "label", "label_name", "split")


register(
    "load_splits",
    "select doc_id, source, cast(length(text) as int) as size, cast(coalesce(list_position(['de', 'en', 'es', 'fr'], coalesce(lang, '')), 0) - 1 as int) as label, "
    "case when lang in ('de', 'en', 'es', 'fr') then lang end as label_name, case doc_id % 3 when 0 then 'train' else 'test' end as split "
    "from documents where doc_id % 3 in (0, 2)",
)(_a1_splits)


def _write_results(s, r):
    base = scratch_path(s, "results")
    data = IO.write_results(r6(results(s, r)), os.path.join(base, "pooled.csv"))
    return base, data


def _a2(s, r):
    # files as the modelled code writes them, with an unnamed index column first, beside files in another order
    base = scratch_path(s, "indexed_results")
    data = results(s, r)
    odd = F.col("dataset") < "p"
    indexed = data.filter(odd).select(F.monotonically_increasing_id().alias("index"), *IO.RESULT_COLUMNS)
    indexed.toDF("", *IO.RESULT_COLUMNS).write.option("header", True).csv(os.path.join(base, "indexed"))
    data.filter(~odd).select(*reversed(IO.RESULT_COLUMNS)).write.option("header", True).csv(os.path.join(base, "reversed"))
    return IO.scan_results_dir(s, base, "*.csv").drop("file")


register("scan_results_dir", rsql(f"select {R6(MS, RES_COLS)}, 'plain' as variant from res"))(_a2)


def _a5(s, r):
    _, data = _write_results(s, r)
    shuffled = IO.write_results(r6(results(s, r)), data.replace("pooled.csv", "shuffled"), variant="shuffled", fmt="parquet", partition_by=("model", "SPC"))
    plain = s.read.schema(f"{IO.RESULT_SCHEMA}, variant string").options(header=True, escape='"').csv(data)
    return plain.unionByName(s.read.parquet(shuffled).select(*plain.columns))


register(
    "write_results",
    rsql(f"select {R6(MS, RES_COLS)}, 'plain' as variant from res union all select {R6(MS, RES_COLS)}, 'shuffled' as variant from res"),
)(_a5)

SPEED_SQL = "select model, dataset, sum(n_examples) / sum(seconds) as examples_per_s from V_runs group by model, dataset"


def _speeds_long(s, r):
    return SCR.throughput(V(s, r).runs(), ("model", "dataset"))


def _a6(s, r):
    path = scratch_path(s, "decoder-speeds")
    IO.write_speed_wide(_speeds_long(s, r), path, RUN_DATASETS)
    return s.read.option("header", True).schema(
        "model string, " + ", ".join(f"{d} double" for d in RUN_DATASETS)
    ).csv(path)


_WIDE_SQL = "select model, " + ", ".join(
    f"avg(case when dataset = '{d}' then examples_per_s end) as {d}" for d in RUN_DATASETS
) + " from sp group by model"
register("write_speed_wide", with_ctes(["V_runs"], [("sp", SPEED_SQL)], _WIDE_SQL))(_a6)


def _a3(s, r):
    base = scratch_path(s, "speedfiles")
    sp = _speeds_long(s, r)
    for m, name in [("org/base", "decoder-speeds-base"), ("large", "decoder-speeds-large")]:
        IO.write_speed_wide(sp.filter(F.col("model") == m), os.path.join(base, name), RUN_DATASETS)
    # a file that must not be picked up by the glob
    sp.limit(0).write.mode("overwrite").option("header", True).csv(os.path.join(base, "notes"))
    return IO.scan_speed_files(s, os.path.join(base, "*speeds*"))


register("scan_speed_files", with_ctes(["V_runs"], [("sp", SPEED_SQL)], _WIDE_SQL))(_a3)


def _a4(s, r):
    path = scratch_path(s, "size_ablation")
    IO.write_wide_baseline(V(s, r).wide_baseline(), path)
    return IO.read_wide_baseline(s, path)


register(
    "read_wide_baseline",
    with_ctes(["V_wide_baseline"], [], "select eval_set, model, full_shot as full_3000_shot, shot_1000, shot_0 from V_wide_baseline"),
)(_a4)

# ---- F2 / A8: pyspark.ml scorer; what is deterministic about it is checked -------------------------


def _corpus_split(s, r):
    """Training and test rows of the corpus: over-long statements left out, split by source row."""
    corpus = build_corpus(V(s, r), None, N, PPC, SPC, SEED).filter(F.col("is_true").isNotNull())
    corpus = max_token_filter(corpus, "statement", MAX_TOKENS)
    # the fit makes several passes (IDF, optimizer); read the capped corpus from Parquet
    corpus = materialize(corpus.withColumn("group_key", F.concat_ws(":", "task", F.col("source_id").cast("string"))), "corpus")
    return S.train_val_split(corpus, 0.1, SEED, "f2", ["task", "sample_idx", "template_id"], group="group_key")


def _f2(s, r):
    train, test = _corpus_split(s, r)
    model = SCR.fit_scorer(train)
    scored = SCR.model_scorer(model)(test).withColumn("ok", (F.col("p_true") >= 0) & (F.col("p_true") <= 1))
    tests = scored.groupBy("task").agg(F.count(F.lit(1)).alias("n_test"), F.count_if("ok").alias("n_scored"))
    return train.groupBy("task").agg(F.count(F.lit(1)).alias("n_train")).join(tests, "task", "full")


def _f2_sql():
    from claimforge.plans.q_ablation import VIEWS, _corpus_ctes

    return with_ctes(VIEWS, _corpus_ctes() + [
        ("short", "select *, concat_ws(':', task, cast(source_id as varchar)) as group_key from corpus where is_true is not null and "
                  "len(list_filter(regexp_split_to_array(statement, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) < 534"),
        ("grp", f"select group_key, row_number() over (order by {sql_hash(SEED, 'f2', 'group_key')}, group_key) as rn_ from (select distinct group_key from short)"),
        ("fold", "select group_key, rn_ <= ceil(round(0.1 * (select count(*) from grp), 9)) as is_test from grp"),
    ], "select task, nullif(count(*) filter (not is_test), 0) as n_train, nullif(count(*) filter (is_test), 0) as n_test, "
       "nullif(count(*) filter (is_test), 0) as n_scored from short join fold using (group_key) group by task")


register("fit_scorer", _f2_sql())(_f2)


def _a8(s, r):
    """The scorers of two runs, stored by number and loaded again: every score is the same."""
    train, _ = _corpus_split(s, r)
    store = SCR.ScorerStore(s, scratch_path(s, "scorers"))
    ev, keys = _eval_long(s, r, ["copa"]), ["dataset", "example_id", "cand_idx"]
    models = {}
    for run, iterations in ((0, 20), (1, 3)):
        models[f"p_fitted_{run}"] = SCR.fit_scorer(train, max_iter=iterations)
        store.save(models[f"p_fitted_{run}"], run)
        models[f"p_true_{run}"] = store.load(run)
    # the statements are built and read once for all four, and their scores, which are small, met by key
    scores = materialize(SCR.model_scorers(models)(ev).select(*keys, *models), "scores")
    parts = []
    for run in (0, 1):
        fitted, loaded = (scores.select(*keys, F.col(f"{p}_{run}").alias(p)) for p in ("p_fitted", "p_true"))
        parts.append(loaded.join(fitted, keys).withColumn("run", F.lit(run)))
    same = F.count_if(F.col("p_true") == F.col("p_fitted")).alias("n_same")
    return S.union_all(parts).groupBy("run", "dataset").agg(F.count(F.lit(1)).alias("n_statements"), same)


_a8_views, _a8_ctes = eval_ctes(["copa"])
register(
    "save_load_scorer",
    with_ctes(_a8_views, _a8_ctes, "select run, dataset, count(*) as n_statements, count(*) as n_same from long_all cross join (values (0), (1)) t(run) group by run, dataset"),
)(_a8)
