"""Ablation sweeps (I1-I5) and replicated evaluation runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from claimforge.operators import ablation as AB
from claimforge.operators import scoring as SCR
from claimforge.operators.corpus import RECIPES, TASKS, corpus_keys, corpus_profile, run_corpora, sample_tasks, statement_keys
from claimforge.plans import sql_corpus as SC
from claimforge.plans.base import N, PPC, SEED, SPC, V, register
from claimforge.plans.q_eval import ARGMAX_SQL, K_WAY, TWO_WAY, _eval_long, eval_ctes, p_sql
from claimforge.plans.sqlviews import q, sql_hash, with_ctes

SPC_SIZES = [1000, 2000, 3000, 4000, 5000, 10000, 20000, 40000, 50000]
PPC_VALUES = [1, 2, 3, 4, 5]
PPC_SWEEP_SPC = 4000
N_RUNS = 3

# The oracle states the sweep itself: variant, tasks left out, rows per task.
_SWEEP = [
    (0, "", 6250),
    (1, "samsum,wikilingua", 7143),
    (2, "samsum,wikilingua,offensive", 7692),
    (3, "samsum,wikilingua,offensive,massive", 8333),
    (4, "samsum,wikilingua,offensive,massive,dpr", 9091),
    (5, "samsum,wikilingua,offensive,massive,dpr,yelp_polarity", 10000),
    (6, "samsum,wikilingua,offensive,massive,dpr,yelp_polarity,mintaka,squad,qasc,sciq,race", 20000),
]
PLAN_SQL = (
    "select variant, excluded, spc, case when excluded = '' then [] else string_split(excluded, ',') end as excluded_list from (values "
    + ", ".join(f"({v}, '{x}', {n})" for v, x, n in _SWEEP) + ") t(variant, excluded, spc)"
)


def _corpus_ctes():
    ctes = []
    for t in TASKS:
        ctes += SC.sql_task_corpus(t, N, PPC, SPC, SEED)
    ctes.append(("corpus", " union all ".join(f"select * from t_{t}_corpus" for t in TASKS)))
    return ctes


def _stm_ctes(ppc=PPC):
    ctes = []
    for t in TASKS:
        ctes += SC.sql_task_statements(t, N, ppc, SEED)
    ctes.append(("stm", " union all ".join(f"select * from t_{t}_st" for t in TASKS)))
    return ctes


VIEWS = SC.views_for(TASKS)


def _profile(s, r):
    return corpus_profile(corpus_keys(V(s, r), None, N, PPC, SPC, SEED))


# ---- I1 / I2 ------------------------------------------------------------------------------------


def _i1(s, r):
    plan = AB.ablation_plan(s)
    prof = _profile(s, r).select("task", "n_statements")
    # one row per task: bounded broadcast
    x = plan.crossJoin(F.broadcast(prof)).filter(~F.array_contains("excluded_list", F.col("task")))
    return x.groupBy("variant", "excluded").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.sum("n_statements").cast("bigint").alias("n_statements")
    )


register(
    "ablation_plan",
    with_ctes(VIEWS, _corpus_ctes() + [
        ("plan", PLAN_SQL),
        ("prof", "select task, count(*) as n_statements from corpus group by task"),
    ], "select variant, excluded, count(*) as n_tasks, cast(sum(n_statements) as bigint) as n_statements from plan "
       "join prof on not list_contains(excluded_list, task) group by variant, excluded"),
)(_i1)


def _source_counts(s, r):
    """Rows that each task can be sampled from (one small aggregate per task, no statement built)."""
    views = V(s, r)
    parts = []
    for t, recipe in RECIPES.items():
        df = getattr(views, recipe.view)()
        df = recipe.pre_filter(df) if recipe.pre_filter else df
        parts.append(df.agg(F.count(F.lit(1)).alias("n_source")).select(F.lit(t).alias("task"), "n_source"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _i2(s, r):
    plan = AB.constant_budget(AB.ablation_plan(s), len(TASKS))
    left = plan.crossJoin(F.broadcast(_source_counts(s, r))).filter(~F.array_contains("excluded_list", F.col("task")))
    return left.groupBy("variant", "excluded", "spc").agg(
        F.count_if(F.col("n_source") > 0).alias("n_tasks"), F.sum("n_source").cast("bigint").alias("n_source")
    )


def _i2_sql():
    parts = []
    for t in TASKS:
        where = {"mnli": " where label >= 0", "snli": " where label >= 0", "race": " where instr(question, ' _') > 0"}.get(t, "")
        parts.append(f"select '{t}' as task, count(*) as n_source from V_{RECIPES[t].view}{where}")
    return with_ctes(VIEWS, [("plan", PLAN_SQL), ("src", " union all ".join(parts))], (
        "select variant, excluded, cast(spc as bigint) as spc, count(*) filter (n_source > 0) as n_tasks, cast(sum(n_source) as bigint) as n_source "
        "from plan join src on not list_contains(excluded_list, task) group by variant, excluded, spc"
    ))


register("constant_budget", _i2_sql())(_i2)

# ---- I3 / I4 / I5 -------------------------------------------------------------------------------


def _sweep(s, r, select, setting, name, ppc=PPC):
    """The corpora that ``select`` picks from the keys of all statements."""
    sample = sample_tasks(V(s, r), TASKS, N, SEED)
    return AB.sweep_statements(sample, select(statement_keys(sample, N, ppc, SEED)), setting, name, N, ppc, SEED)


def _i3(s, r):
    plan = AB.constant_budget(AB.ablation_plan(s), len(TASKS))
    return _sweep(s, r, lambda keys: AB.ablation_corpora(keys, plan, SEED), "variant", "variants")


ORDER_SQL = sql_hash(SEED, "strat", "task", "sample_idx", "template_id")


def _whole(setting: str, name: str, picked: str) -> list[tuple[str, str]]:
    """Statements with the sorted settings of the keys in ``picked``."""
    return [("sel", f"select task, sample_idx, template_id, list_sort(list({setting})) as {name} from ({picked}) group by task, sample_idx, template_id")]


def _quota_ctes(p: str, cnt: str, parent: list[str]) -> list[tuple[str, str]]:
    """Largest-remainder quotas from a CTE with ``parent + [is_true, n, req]``."""
    part = "partition by " + ", ".join(parent)
    return [
        (f"{p}_qa", f"select *, sum(n) over ({part}) as tot from {cnt}"),
        (f"{p}_qb", f"select *, least(cast(req as bigint), cast(tot as bigint)) as k from {p}_qa"),
        (f"{p}_qc", f"select *, (k * n) // tot as base, (k * n) % tot as rem from {p}_qb"),
        (f"{p}_qd", f"select *, k - sum(base) over ({part}) as lft, row_number() over ({part} order by rem desc, is_true) as rr from {p}_qc"),
        (f"{p}_quota", f"select {', '.join(parent)}, is_true, cast(base + case when rr <= lft then 1 else 0 end as bigint) as quota from {p}_qd"),
    ]


register(
    "ablation_corpora",
    with_ctes(VIEWS, _stm_ctes() + [
        ("plan", PLAN_SQL),
        ("cnt0", "select task, is_true, count(*) as n from stm group by task, is_true"),
        ("cnt", "select p.variant, c.task, c.is_true, c.n, cast(p.spc as bigint) as req from cnt0 c cross join plan p where not list_contains(p.excluded_list, c.task)"),
    ] + _quota_ctes("ab", "cnt", ["variant", "task"]) + [
        ("rk", f"select task, is_true, sample_idx, template_id, row_number() over (partition by task, is_true order by {ORDER_SQL}, task, sample_idx, template_id) as rn_ from stm"),
    ] + _whole("variant", "variants", "select rk.*, q.variant from rk join ab_quota q using (task, is_true) where rn_ <= q.quota"),
        "select stm.*, sel.variants from stm join sel using (task, sample_idx, template_id)"),
)(_i3)


def _i4(s, r):
    return _sweep(s, r, lambda keys: AB.spc_sweep(keys, SPC_SIZES, SEED), "spc", "spcs")


register(
    "spc_sweep",
    with_ctes(VIEWS, _stm_ctes() + [
        ("sz", "select * from (values " + ", ".join(f"({x})" for x in SPC_SIZES) + ") t(spc)"),
        ("cnt0", "select task, is_true, count(*) as n from stm group by task, is_true"),
        ("cnt", "select cast(sz.spc as bigint) as spc, c.task, c.is_true, c.n, sz.spc as req from cnt0 c cross join sz"),
    ] + _quota_ctes("sw", "cnt", ["spc", "task"]) + [
        ("rk", f"select task, is_true, sample_idx, template_id, row_number() over (partition by task, is_true order by {ORDER_SQL}, task, sample_idx, template_id) as rn_ from stm"),
    ] + _whole("spc", "spcs", "select rk.*, q.spc from rk join sw_quota q using (task, is_true) where rn_ <= q.quota"),
        "select stm.*, sel.spcs from stm join sel using (task, sample_idx, template_id)"),
)(_i4)


def _i5(s, r):
    return _sweep(s, r, lambda keys: AB.ppc_sweep(keys, PPC_VALUES, PPC_SWEEP_SPC, SEED), "ppc", "ppcs", max(PPC_VALUES))


def _ranks_sql():
    rows = []
    from claimforge.functions.draws import py_hash_key
    from claimforge.operators.corpus import RECIPES
    from claimforge.operators.templates import TRAIN_TEMPLATES

    for task in TASKS:
        tset = RECIPES[task].template_set
        for group, ts in TRAIN_TEMPLATES[tset].items():
            order = sorted(range(len(ts)), key=lambda i: (py_hash_key(SEED, f"tpl:{task}:{group}", i), i))
            for rank, i in enumerate(order, start=1):
                rows.append((task, AB.template_id_of(task, group, i), rank))
        rows.append((task, -1, 0))
    return "select * from (values " + ", ".join(f"({q(t)}, {i}, {k})" for t, i, k in rows) + ") t(task, template_id, tpl_rank)"


register(
    "ppc_sweep",
    with_ctes(VIEWS, _stm_ctes(max(PPC_VALUES)) + [
        ("rk0", _ranks_sql()),
        ("pp", "select * from (values " + ", ".join(f"({p})" for p in PPC_VALUES) + ") t(ppc)"),
        ("x", "select s.task, s.is_true, s.sample_idx, s.template_id, pp.ppc from stm s join rk0 using (task, template_id) cross join pp where rk0.tpl_rank <= pp.ppc"),
        ("cnt", f"select ppc, task, is_true, count(*) as n, {PPC_SWEEP_SPC} as req from x group by ppc, task, is_true"),
    ] + _quota_ctes("pc", "cnt", ["ppc", "task"]) + [
        ("rk", f"select *, row_number() over (partition by ppc, task, is_true order by {ORDER_SQL}, task, sample_idx, template_id) as rn_ from x"),
    ] + _whole("ppc", "ppcs", "select rk.* from rk join pc_quota q using (ppc, task, is_true) where rn_ <= q.quota"),
        "select stm.*, sel.ppcs from stm join sel using (task, sample_idx, template_id)"),
)(_i5)

# ---- I7: replicated evaluation runs ---------------------------------------------------------------


def _run_preds(s, r, run):
    multi = SCR.argmax_candidates(SCR.keyed_scorer(_eval_long(s, r, TWO_WAY + K_WAY, run), SEED + run))
    mrpc = SCR.argmax_logits(SCR.keyed_logits(_eval_long(s, r, ["mrpc"], run), SEED + run)).select("dataset", "example_id", "pred", "label")
    return multi.unionByName(mrpc).withColumn("run", F.lit(run))


def _i7(s, r):
    preds = reduce(lambda a, b: a.unionByName(b), [_run_preds(s, r, k) for k in range(N_RUNS)])
    return SCR.accuracy_by(preds, ("run", "dataset"))


def _i7_sql():
    views, ctes, parts = [], [], []
    for k in range(N_RUNS):
        p = f"r{k}_"
        v, c = eval_ctes(TWO_WAY + K_WAY + ["mrpc"], k, p)
        views += [x for x in v if x not in views]
        ctes += c
        ctes.append((f"{p}scored", f"select *, {p_sql(seed=SEED + k)} as p_true from {p}long_all where dataset <> 'mrpc'"))
        ctes.append((f"{p}mc", ARGMAX_SQL.replace("from scored", f"from {p}scored")))
        ctes.append((f"{p}lg", f"select *, [{p_sql('l0', SEED + k)}, {p_sql('l1', SEED + k)}] as logits from {p}l_mrpc"))
        ctes.append((f"{p}mp", f"select dataset, example_id, cast(list_position(logits, list_max(logits)) - 1 as int) as pred, label from {p}lg"))
        parts.append(f"select {k} as run, * from {p}mc union all select {k} as run, * from {p}mp")
    ctes.append(("preds", " union all ".join(parts)))
    return with_ctes(views, ctes, (
        "select run, dataset, avg(cast(pred = label as double)) as accuracy, count(*) as n_examples from preds group by run, dataset"
    ))


register("replicated_runs", _i7_sql())(_i7)

# ---- I7: replicated corpora -------------------------------------------------------------------------

RUN_TASKS = ["qqp", "mnli", "snli", "squad", "dpr", "sciq"]
RUN_N, RUN_PPC, RUN_SPC = 2000, 2, 1000


def _i7_corpora(s, r):
    """Every run draws its own corpus: size, balance and how many of its statements no other run has."""
    runs = run_corpora(V(s, r), [SEED + k for k in range(N_RUNS)], None, RUN_N, RUN_PPC, RUN_SPC, RUN_TASKS)
    rows = reduce(lambda a, b: a.unionByName(b), [
        whole().select(F.lit(seed - SEED).alias("run"), "task", "source_id", "template_id", "is_true", "statement") for seed, (_, whole) in runs.items()
    ])
    once = rows.groupBy("task", "statement").agg(F.count_distinct("run").alias("runs"), F.min("run").alias("run"))
    own = once.filter("runs = 1").groupBy("run", "task").agg(F.count(F.lit(1)).alias("n_own"))
    sizes = rows.groupBy("run", "task").agg(
        F.count(F.lit(1)).alias("n_statements"), F.sum("is_true").cast("bigint").alias("n_true"), F.count_distinct("source_id").alias("n_sources")
    )
    return sizes.join(own, ["run", "task"], "left").fillna(0, ["n_own"])


def _i7_corpora_sql():
    ctes, parts = [], []
    for k in range(N_RUNS):
        for t in RUN_TASKS:
            own = SC.sql_task_corpus(t, RUN_N, RUN_PPC, RUN_SPC, SEED + k)
            ctes += [(name.replace("t_", f"r{k}_", 1), sql.replace(f"t_{t}_", f"r{k}_{t}_")) for name, sql in own]
            parts.append(f"select {k} as run, task, source_id, template_id, is_true, statement from r{k}_{t}_corpus")
    ctes.append(("rows_", " union all ".join(parts)))
    ctes.append(("once", "select task, statement, min(run) as run from rows_ group by task, statement having count(distinct run) = 1"))
    ctes.append(("own", "select run, task, count(*) as n_own from once group by run, task"))
    ctes.append(("sizes", "select run, task, count(*) as n_statements, cast(sum(is_true) as bigint) as n_true, count(distinct source_id) as n_sources from rows_ group by run, task"))
    return with_ctes(SC.views_for(RUN_TASKS), ctes, "select run, task, n_statements, n_true, n_sources, coalesce(n_own, 0) as n_own from sizes left join own using (run, task)")


register("replicated_corpora", _i7_corpora_sql())(_i7_corpora)
