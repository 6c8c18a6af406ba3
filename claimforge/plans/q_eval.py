"""Evaluation-side queries: evaluation sets (D), scoring, arg-max and metrics (F)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from claimforge.functions.text import render_prompt, shuffle_words
from claimforge.operators import evalsets as EV
from claimforge.operators import scoring as SCR
from claimforge.operators.templates import CLASS_NAMES, EVAL_TEMPLATES, PROMPTS, eval_template_draw, template_table
from claimforge.plans.base import SEED, V, register
from claimforge.plans.sqlviews import q, sql_fill, sql_hash, sql_shuffle, with_ctes

# ---------------------------------------------------------------------------------------------
# SQL twins of the evaluation inputs and builders
# ---------------------------------------------------------------------------------------------

EVAL_INPUT_SQL = {
    "copa": ("select * from V_copa", ["V_copa"]),
    "mrpc": ("select * from V_pairs", ["V_pairs"]),
    "amazon_p": (
        "select id, split_part(text, '.', 1) as title, substring(text, length(split_part(text, '.', 1)) + 2) as content, label from V_bin",
        ["V_bin"],
    ),
    "figqa": (
        "select id, sentence as startphrase, option1 as ending1, option2 as ending2, label as labels from V_choice",
        ["V_choice"],
    ),
    "storycloze": ("select * from V_story", ["V_story"]),
    "yahoo": ("select * from V_topic", ["V_topic"]),
    "emotion": ("select * from V_emotion", ["V_emotion"]),
}

# The oracle states the class names and the length limit itself.
TOPICS = ["gardening", "astronomy", "cooking", "law", "football", "painting", "banking", "travel", "medicine", "programming"]
EMOTIONS = ["calm", "disgust", "pride", "boredom", "hope", "envy"]
SHORT_SQL = (
    "select * from {0} where example_id in (select example_id from {0} group by example_id "
    "having max(len(list_filter(regexp_split_to_array(statement, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))) < 514)"
)

DATASETS = list(EVAL_INPUT_SQL)
TWO_WAY = ["copa", "amazon_p", "figqa", "storycloze"]
K_WAY = ["yahoo", "emotion"]


def _cands_sql(d: str, run: int = 0) -> tuple[list[str], str]:
    """(statement SQL per candidate, label SQL) for dataset ``d``."""
    t = lambda fam: EV.pick_eval_template(SEED, d, fam, run)[1]
    if d == "copa":
        return [
            f"case when question = 'cause' then {sql_fill(t('cause'), ['premise', c])} else {sql_fill(t('effect'), ['premise', c])} end"
            for c in ["choice1", "choice2"]
        ], "label"
    if d == "mrpc":
        return [sql_fill(t("all"), ["text1", "text2"])], "label"
    if d == "amazon_p":
        return [sql_fill(t("0"), ["title", "content"]), sql_fill(t("1"), ["title", "content"])], "label"
    if d == "figqa":
        return [sql_fill(t("all"), ["startphrase", e]) for e in ["ending1", "ending2"]], "labels"
    if d == "storycloze":
        ctx = [f"input_sentence_{i}" for i in range(1, 5)]
        return [sql_fill(t("all"), ctx + [e]) for e in ["sentence_quiz1", "sentence_quiz2"]], "answer_right_ending - 1"
    if d == "yahoo":
        return [sql_fill(t("all"), ["title", "content", q(n)]) for n in TOPICS], "label"
    if d == "emotion":
        return [sql_fill(t("all"), ["text", q(n)]) for n in EMOTIONS], "label"
    raise ValueError(d)


def eval_ctes(datasets, run: int = 0, prefix: str = "") -> tuple[list[str], list[tuple[str, str]]]:
    views, ctes = [], []
    for d in datasets:
        sql, vs = EVAL_INPUT_SQL[d]
        views += [v for v in vs if v not in views]
        ctes.append((f"{prefix}e_{d}", sql))
        stmts, label = _cands_sql(d, run)
        parts = [
            f"select {q(d)} as dataset, id as example_id, {k} as cand_idx, {s} as statement, cast({label} as int) as label "
            f"from {prefix}e_{d}"
            for k, s in enumerate(stmts)
        ]
        if d in K_WAY:
            ctes.append((f"{prefix}u_{d}", " union all ".join(parts)))
            parts = [SHORT_SQL.format(f"{prefix}u_{d}")]
        ctes.append((f"{prefix}l_{d}", " union all ".join(parts)))
    ctes.append((f"{prefix}long_all", " union all ".join(f"select * from {prefix}l_{d}" for d in datasets)))
    return views, ctes


P_SQL = "(('0x' || substr(md5(concat_ws(':', '{seed}', '{salt}', statement)), 1, 8))::BIGINT / CAST(4294967296 AS DOUBLE))"


def p_sql(salt="score", seed=SEED):
    return P_SQL.format(seed=seed, salt=salt)


def _eval_long(spark, root, datasets=None, run=0):
    sets = EV.build_eval_sets(V(spark, root), SEED, run, False, datasets)
    return reduce(lambda a, b: a.unionByName(b), sets.values())


# ---------------------------------------------------------------------------------------------
# D1 - D7
# ---------------------------------------------------------------------------------------------

D_KEYS = {
    "eval_cause_effect": "copa",
    "eval_pair": "mrpc",
    "eval_polarity_pair": "amazon_p",
    "eval_two_endings": "figqa",
    "eval_story_ending": "storycloze",
    "eval_topic_candidates": "yahoo",
    "eval_emotion_candidates": "emotion",
}

for _key, _d in D_KEYS.items():
    _views, _ctes = eval_ctes([_d])
    register(_key, with_ctes(_views, _ctes, "select * from long_all"))(
        (lambda d: (lambda spark, root: _eval_long(spark, root, [d])))(_d)
    )

# ---------------------------------------------------------------------------------------------
# D8 shuffle_words (whole documents), D9 render_prompt, D10 prompt_slots, D11 eval_template_draw
# ---------------------------------------------------------------------------------------------


def _d8(spark, root):
    docs = V(spark, root).table("documents")
    return docs.select("doc_id", shuffle_words(F.col("text"), SEED, "shuf:doc", F.col("doc_id")).alias("shuffled"))


register(
    "shuffle_words",
    f"select doc_id, {sql_shuffle('text', SEED, 'shuf:doc', 'doc_id')} as shuffled from documents",
)(_d8)


def _shuffled(spark, root):
    """D1 with the shuffle flag: every slot value is shuffled before it is filled in."""
    return EV.build_eval_sets(V(spark, root), SEED, 0, True, ["copa"])["copa"]


def _shuffled_sql():
    t = lambda fam: EV.pick_eval_template(SEED, "copa", fam, 0)[1]
    parts = []
    for k, c in enumerate(["choice1", "choice2"]):
        key = f"concat_ws(':', cast(id as varchar), '{k}')"
        vals = [sql_shuffle("premise", SEED, "shuf:copa:1", key), sql_shuffle(c, SEED, "shuf:copa:2", key)]
        parts.append(
            f"select 'copa' as dataset, id as example_id, {k} as cand_idx, case when question = 'cause' then {sql_fill(t('cause'), vals)} "
            f"else {sql_fill(t('effect'), vals)} end as statement, cast(label as int) as label from V_copa"
        )
    return with_ctes(["V_copa"], [], " union all ".join(parts))


register("eval_shuffled", _shuffled_sql())(_shuffled)


def _wide(spark, root):
    """D6 in wide form: one row per example, one column per candidate."""
    return EV.wide_candidates(_eval_long(spark, root, ["yahoo"]), len(CLASS_NAMES["topic"]))


_views, _ctes = eval_ctes(["yahoo"])
register("eval_topic_wide", with_ctes(_views, _ctes, (
    "select dataset, example_id, label, " + ", ".join(f"max(case when cand_idx = {k} then statement end) as statement{k}" for k in range(10))
    + " from long_all group by dataset, example_id, label"
)))(_wide)

PROMPT_INPUT = {
    "copa": "copa", "mrpc": "mrpc", "figqa": "figqa_src", "amazon_p": "bin", "yahoo": "multi", "emotion": "multi",
}
PROMPT_INPUT_SQL = {
    "copa": ("V_copa", ["V_copa"]), "mrpc": ("V_pairs", ["V_pairs"]), "figqa": ("V_choice", ["V_choice"]),
    "amazon_p": ("V_bin", ["V_bin"]), "yahoo": ("V_multi", ["V_multi"]), "emotion": ("V_multi", ["V_multi"]),
}


def _prompt_frames(spark, root):
    v = V(spark, root)
    return {"copa": v.copa(), "mrpc": v.pairs(), "figqa": v.choice(), "amazon_p": v.bin(), "yahoo": v.multi(), "emotion": v.multi()}


def _d9(spark, root):
    frames = _prompt_frames(spark, root)
    outs = [
        frames[d].select(F.lit(d).alias("dataset"), F.col("id").alias("example_id"), render_prompt(PROMPTS[d]).alias("prompt"))
        for d in PROMPT_INPUT
    ]
    return reduce(lambda a, b: a.unionByName(b), outs)


def _render_sql(tpl: str) -> str:
    import re

    out = q(tpl)
    for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}", tpl):
        out = f"replace({out}, {q(m.group(0))}, cast({m.group(1)} as varchar))"
    return out


_d9_views = sorted({v for _, (_, vs) in PROMPT_INPUT_SQL.items() for v in vs})
register(
    "render_prompt",
    with_ctes(_d9_views, [], " union all ".join(
        f"select {q(d)} as dataset, id as example_id, {_render_sql(PROMPTS[d])} as prompt from {PROMPT_INPUT_SQL[d][0]}"
        for d in PROMPT_INPUT
    )),
)(_d9)


def _d10(spark, root):
    rows = [(d, t) for d, t in PROMPTS.items()]
    tpl = spark.createDataFrame(rows, "dataset string, template string")
    slots = tpl.select("dataset", F.regexp_extract_all("template", F.lit(r"\{\{\s*(\w+)\s*\}\}"), 1).alias("slots"))
    counts = EV.example_counts(V(spark, root), SEED, 0, list(PROMPTS))
    return slots.join(counts, "dataset")


def _count_sql(datasets) -> str:
    """Examples of the sets, by their built statements."""
    return " union all ".join(f"select {q(d)} as dataset, count(*) as n_examples from l_{d} where cand_idx = 0" for d in datasets)


_d10_views, _d10_ctes = eval_ctes(list(PROMPTS))
register(
    "prompt_slots",
    with_ctes(_d10_views, _d10_ctes + [
        ("tpl", "select * from (values " + ", ".join(f"({q(d)}, {q(t)})" for d, t in PROMPTS.items()) + ") t(dataset, template)"),
        ("cnt", _count_sql(PROMPTS)),
    ], "select tpl.dataset, regexp_extract_all(template, '\\{\\{\\s*(\\w+)\\s*\\}\\}', 1) as slots, n_examples "
       "from tpl join cnt on cnt.dataset = tpl.dataset"),
)(_d10)


def _d11(spark, root):
    runs = V(spark, root).runs().select(F.col("model_no").alias("run")).distinct()
    return eval_template_draw(spark, template_table(spark, EVAL_TEMPLATES), runs, SEED)


def _d11_sql():
    rows = [(t, g, i, s) for t, gs in EVAL_TEMPLATES.items() for g, ts in gs.items() for i, s in enumerate(ts)]
    vals = ", ".join(f"({q(t)}, {q(g)}, {i}, {q(s)})" for t, g, i, s in rows)
    return with_ctes(["V_runs"], [
        ("tpl", f"select * from (values {vals}) t(task, grp, template_id, template)"),
        ("sizes", "select task, grp, count(*) as n_t from tpl group by task, grp"),
        ("runs", "select distinct model_no as run from V_runs"),
        ("pick", (
            f"select r.run, s.task, s.grp, cast(('0x' || substr({sql_hash(SEED, 'evt', 's.task', 's.grp', 'r.run')}, 1, 8))::BIGINT "
            f"% s.n_t as int) as template_id from runs r cross join sizes s"
        )),
    ], "select p.run, p.task, p.grp, p.template_id, t.template from pick p join tpl t using (task, grp, template_id)")


register("eval_template_draw", _d11_sql())(_d11)

# ---------------------------------------------------------------------------------------------
# F1 score, F3/F4 arg-max, F5 logits, F6 accuracy, F7 binary metrics, F8 softmax, F9, F10
# ---------------------------------------------------------------------------------------------


def _scored(spark, root, datasets=None):
    return SCR.keyed_scorer(_eval_long(spark, root, datasets), SEED)


def _scored_sql(datasets):
    views, ctes = eval_ctes(datasets)
    ctes.append(("scored", f"select *, {p_sql()} as p_true from long_all"))
    return views, ctes


_v, _c = _scored_sql(DATASETS)
register(
    "score_statements",
    with_ctes(_v, _c, "select dataset, example_id, cand_idx, p_true from scored"),
)(lambda spark, root: _scored(spark, root).select("dataset", "example_id", "cand_idx", "p_true"))

ARGMAX_SQL = (
    "select dataset, example_id, cand_idx as pred, label from (select *, row_number() over "
    "(partition by dataset, example_id order by p_true desc, cand_idx) as rn_ from scored) where rn_ = 1"
)

_v, _c = _scored_sql(TWO_WAY)
register("argmax_two", with_ctes(_v, _c, ARGMAX_SQL))(lambda spark, root: SCR.argmax_candidates(_scored(spark, root, TWO_WAY)))
_v, _c = _scored_sql(K_WAY)
register("argmax_k", with_ctes(_v, _c, ARGMAX_SQL))(lambda spark, root: SCR.argmax_candidates(_scored(spark, root, K_WAY)))


def _mrpc_pred(spark, root):
    m = SCR.keyed_logits(_eval_long(spark, root, ["mrpc"]), SEED)
    return SCR.argmax_logits(m).select("dataset", "example_id", "pred", "label")


def _mrpc_pred_sql():
    views, ctes = eval_ctes(["mrpc"])
    ctes.append(("lg", f"select *, [{p_sql('l0')}, {p_sql('l1')}] as logits from long_all"))
    ctes.append(("mp", "select dataset, example_id, cast(list_position(logits, list_max(logits)) - 1 as int) as pred, label from lg"))
    return views, ctes


_v, _c = _mrpc_pred_sql()
register("argmax_logits", with_ctes(_v, _c, "select * from mp"))(_mrpc_pred)


def _all_preds(spark, root):
    multi = SCR.argmax_candidates(_scored(spark, root, TWO_WAY + K_WAY))
    return multi.unionByName(_mrpc_pred(spark, root))


def _all_preds_sql():
    views, ctes = eval_ctes(DATASETS)
    ctes.append(("scored", f"select *, {p_sql()} as p_true from long_all where dataset <> 'mrpc'"))
    ctes.append(("mc", ARGMAX_SQL))
    ctes.append(("lg", f"select *, [{p_sql('l0')}, {p_sql('l1')}] as logits from l_mrpc"))
    ctes.append(("mp", "select dataset, example_id, cast(list_position(logits, list_max(logits)) - 1 as int) as pred, label from lg"))
    ctes.append(("preds", "select * from mc union all select * from mp"))
    return views, ctes


_v, _c = _all_preds_sql()
register(
    "accuracy_by_dataset",
    with_ctes(_v, _c, (
        "select dataset, avg(cast(pred = label as double)) as accuracy, count(*) as n_examples from preds group by dataset"
    )),
)(lambda spark, root: SCR.accuracy_by(_all_preds(spark, root)).select(
    "dataset", "accuracy", "n_examples"))

_v, _c = _mrpc_pred_sql()
register(
    "binary_metrics",
    with_ctes(_v, _c + [(
        "bm", (
            "select avg(cast(pred = label as double)) as accuracy, sum(case when pred = 1 and label = 1 then 1 else 0 end) as tp, "
            "sum(case when pred = 1 and label <> 1 then 1 else 0 end) as fp, sum(case when pred <> 1 and label = 1 then 1 else 0 end) as fn from mp"
        ),
    )], (
        "select accuracy, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else CAST(0 AS DOUBLE) end as f1, "
        "case when tp + fp > 0 then tp / (tp + fp) else CAST(0 AS DOUBLE) end as precision, "
        "case when tp + fn > 0 then tp / (tp + fn) else CAST(0 AS DOUBLE) end as recall from bm"
    )),
)(lambda spark, root: SCR.binary_metrics(_mrpc_pred(spark, root)))


def _f8(spark, root):
    out = SCR.softmax_pair(_scored(spark, root, ["copa"]))
    return out.select("dataset", "example_id", "label", F.round("p_label", 6).alias("p_label"), F.round("loss", 6).alias("loss"))


_v, _c = _scored_sql(["copa"])
register(
    "softmax_pair",
    with_ctes(_v, _c + [
        ("mx", "select dataset, example_id, max(p_true) as m, max(label) as label from scored group by dataset, example_id"),
        ("sm", (
            "select s.dataset, s.example_id, x.label, exp(max(case when s.cand_idx = x.label then s.p_true end) - x.m) / "
            "sum(exp(s.p_true - x.m)) as p_label from scored s join mx x using (dataset, example_id) "
            "group by s.dataset, s.example_id, x.label, x.m"
        )),
    ], "select dataset, example_id, label, round(p_label, 6) as p_label, round(-ln(p_label), 6) as loss from sm"),
)(_f8)

COST = {"click": 10, "view": 6}  # candidate answers per example of these sets
DEFAULT_COST = 2


def _f9(spark, root):
    runs = V(spark, root).runs()
    out = SCR.throughput(runs, ("model", "dataset"), cost=COST, default_cost=DEFAULT_COST)
    return out.select("model", "dataset", "examples_per_s", "statements_per_s")


_cost_case = "case dataset " + " ".join(f"when {q(k)} then {v}" for k, v in COST.items()) + f" else {DEFAULT_COST} end"
register(
    "throughput",
    with_ctes(["V_runs"], [("tp", "select model, dataset, sum(n_examples) / sum(seconds) as eps from V_runs group by model, dataset")],
              f"select model, dataset, eps as examples_per_s, eps * {_cost_case} as statements_per_s from tp"),
)(_f9)


def random_rows(spark, root):
    """Random baseline of the seven sets: ``dataset, model, n_examples, accuracy``."""
    counts = EV.example_counts(V(spark, root), SEED)
    return SCR.random_baseline(counts, EV.SET_SIZES).select("dataset", "model", "n_examples", "accuracy")


def _f10(spark, root):
    return random_rows(spark, root).withColumn("accuracy", F.round("accuracy", 6))


_v, _c = eval_ctes(DATASETS)
register(
    "random_baseline",
    with_ctes(_v, _c + [("cnt", _count_sql(DATASETS))], (
        "select dataset, 'random' as model, n_examples, round(CAST(1 AS DOUBLE) / k, 6) as accuracy from cnt join (values "
        "('copa', 2), ('mrpc', 2), ('amazon_p', 2), ('figqa', 2), ('storycloze', 2), ('yahoo', 10), ('emotion', 6)) s(dataset, k) using (dataset)"
    )),
)(_f10)
