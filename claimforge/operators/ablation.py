"""Ablation sweeps as data jobs.

A sweep is a small *plan* table (one row per variant) broadcast against the keys of
all statements; every variant's corpus is then one stratified selection partitioned
by (variant, task).  Nothing loops on the driver per variant, and texts come last
(``sweep_statements``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimforge.functions.draws import hash_key, py_hash_key
from claimforge.operators.corpus import KEYS, RECIPES, TASKS, chosen_statements
from claimforge.operators.sampling import largest_remainder_quotas, take_first
from claimforge.operators.templates import TRAIN_TEMPLATES

# The task groups that the leave-groups-out sweep removes one after another.
LEAVE_OUT_GROUPS = [
    ["samsum", "wikilingua"],
    ["offensive"],
    ["massive"],
    ["dpr"],
    ["yelp_polarity"],
    ["mintaka", "squad", "qasc", "sciq", "race"],
]
BUDGET = 100000


def ablation_plan(spark: SparkSession, groups=LEAVE_OUT_GROUPS) -> DataFrame:
    """Variant k excludes the first k groups (k = 0..len)."""
    rows = [(k, [t for g in groups[:k] for t in g], ",".join(t for g in groups[:k] for t in g)) for k in range(len(groups) + 1)]
    return spark.createDataFrame(rows, "variant int, excluded_list array<string>, excluded string")


def constant_budget(plan: DataFrame, n_tasks: int, budget: int = BUDGET) -> DataFrame:
    """Rows per task keeping the corpus near ``budget``: round(budget / tasks left)."""
    left = F.lit(n_tasks) - F.size("excluded_list")
    return plan.withColumn("n_tasks", left).withColumn("spc", F.round(F.lit(float(budget)) / left).cast("bigint"))


def nested_select(statements: DataFrame, quotas: DataFrame, seed, key_cols=("sample_idx", "template_id")) -> DataFrame:
    """Rows whose rank in their (task, is_true) stratum is below ``quota``, for every row of ``quotas``.

    ``quotas`` holds ``(setting columns..., task, is_true, quota)``.  The md5 order of a stratum does
    not depend on the setting, so the rank is computed once, on the candidates of the largest quota
    only (an output-sized set), and each setting is a filter on it: smaller corpora nest in larger ones.
    """
    key_cols = list(key_cols)
    order = hash_key(seed, "strat", "task", *key_cols)
    top = quotas.groupBy("task", "is_true").agg(F.max("quota").alias("quota"))
    cand = take_first(statements, order, ["task"] + key_cols, top, ["task", "is_true"])
    # cand holds at most max(quota) rows per stratum (bounded by the sweep, not by the data),
    # so a window per stratum is safe even when one task holds most of the rows
    w = Window.partitionBy("task", "is_true").orderBy(order, *(["task"] + key_cols))
    ranked = cand.withColumn("_rk", F.row_number().over(w) - 1)
    # quotas has one row per (setting, task, stratum): bounded by settings x tasks x 2
    return ranked.join(F.broadcast(quotas), ["task", "is_true"]).filter(F.col("_rk") < F.col("quota")).drop("_rk", "quota")


def ablation_corpora(statements: DataFrame, plan: DataFrame, seed, key_cols=("sample_idx", "template_id")) -> DataFrame:
    """One corpus per variant: its excluded tasks dropped, a stratified cap of ``spc`` per (variant, task)."""
    counts = statements.groupBy("task", "is_true").agg(F.count(F.lit(1)).alias("n"))
    per_variant = counts.crossJoin(F.broadcast(plan.select("variant", "excluded_list", "spc"))).filter(
        ~F.array_contains("excluded_list", F.col("task"))
    )
    quotas = largest_remainder_quotas(per_variant, "spc", ["variant", "task"], "is_true")
    return nested_select(statements, quotas, seed, key_cols)


def spc_sweep(statements: DataFrame, sizes, seed, key_cols=("sample_idx", "template_id")) -> DataFrame:
    """I4: corpora for several sizes (caps bite at each task's own length), nested."""
    spark = statements.sparkSession
    sz = spark.createDataFrame([(int(s),) for s in sizes], "spc long")
    counts = statements.groupBy("task", "is_true").agg(F.count(F.lit(1)).alias("n"))
    quotas = largest_remainder_quotas(counts.crossJoin(F.broadcast(sz)), "spc", ["spc", "task"], "is_true")
    return nested_select(statements, quotas, seed, key_cols)


def template_id_of(task: str, group: str, i: int) -> int:
    """Template ids used by the builders for (task, group, index)."""
    tset = RECIPES[task].template_set
    groups = list(TRAIN_TEMPLATES[tset])
    if tset == "qqp":
        return i if group == "pos" else 100 + i
    if tset in ("nli", "polarity"):
        return int(group) * 100 + i
    if tset in ("qasc", "sciq"):
        return groups.index(group) * 100 + i
    return i


def template_ranks(spark: SparkSession, seed, tasks=TASKS) -> DataFrame:
    """Rank of every template inside its group in the md5 order used by B5 (blank rows rank 0)."""
    rows = []
    for task in tasks:
        tset = RECIPES[task].template_set
        for group, ts in TRAIN_TEMPLATES[tset].items():
            order = sorted(range(len(ts)), key=lambda i: (py_hash_key(seed, f"tpl:{task}:{group}", i), i))
            for rank, i in enumerate(order, start=1):
                rows.append((task, template_id_of(task, group, i), rank))
        rows.append((task, -1, 0))
    return spark.createDataFrame(rows, "task string, template_id int, tpl_rank int")


def ppc_sweep(statements: DataFrame, ppcs, spc: int, seed, key_cols=("sample_idx", "template_id")) -> DataFrame:
    """Corpora for several templates-per-class settings from one statement table.

    Statements must be built with ``max(ppcs)`` templates; setting ``p`` keeps templates of
    rank <= p in each group, then caps each task to ``spc`` (stratified).
    """
    key_cols = list(key_cols)
    spark = statements.sparkSession
    ranks = template_ranks(spark, seed)
    pp = spark.createDataFrame([(int(p),) for p in ppcs], "ppc int")
    x = statements.join(F.broadcast(ranks), ["task", "template_id"]).crossJoin(F.broadcast(pp)).filter(
        F.col("tpl_rank") <= F.col("ppc")
    ).drop("tpl_rank")
    counts = x.groupBy("ppc", "task", "is_true").agg(F.count(F.lit(1)).alias("n"))
    quotas = largest_remainder_quotas(counts, int(spc), ["ppc", "task"], "is_true")
    order = hash_key(seed, "strat", "task", *key_cols)
    return take_first(x, order, ["task"] + key_cols, quotas, ["ppc", "task", "is_true"])


def sweep_statements(sample: dict[str, DataFrame], selected: DataFrame, setting: str, name: str, n, ppc, seed) -> DataFrame:
    """The corpora of a sweep with whole statements: each statement once, and in ``name`` the sorted settings
    whose corpora hold it.

    ``selected`` has a row per setting and key.  Corpora of a sweep share most statements, so a text is filled
    in once, from the sampled rows, and never moved; ``corpus_of`` gives one corpus.
    """
    chosen = selected.groupBy(*KEYS).agg(F.sort_array(F.collect_list(setting)).alias(name))  # settings of a plan
    return chosen_statements(sample, chosen, n, ppc, seed, name)


def corpus_of(sweep: DataFrame, name: str, setting) -> DataFrame:
    """The corpus of one setting of a sweep."""
    return sweep.filter(F.array_contains(name, F.lit(setting))).drop(name)
