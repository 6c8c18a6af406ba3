"""Corpus-side queries: sampling (B), statement builders (C), corpus assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.functions.draws import draw_mod
from claimforge.functions.text import fill_template
from claimforge.operators import builders as B
from claimforge.operators import sampling as S
from claimforge.operators.corpus import RECIPES, build_corpus, corpus_keys, corpus_profile, sample_tasks, task_corpus, task_statements, template_choice
from claimforge.plans import sql_corpus as SC
from claimforge.plans.base import N, PPC, SEED, SPC, V, register
from claimforge.plans.sqlviews import sql_draw, sql_hash, with_ctes


# =============================================================================================
# C: statement builders (per task statements, before the stratified cap)
# =============================================================================================

BUILDER_KEYS = {
    "build_pair_compare": "qqp",
    "build_multiple_choice": "piqa",
    "build_blank_fill": "winogrande",
    "build_class_template": "mnli",
    "build_shifted_answer": "mintaka",
    "build_span": "squad",
    "build_binary_class": "offensive",
    "build_multi_class": "massive",
    "build_substitution": "dpr",
    "build_lettered_choice": "qasc",
    "build_distractor": "sciq",
    "build_cloze_options": "race",
}


def _task_statements_sql(task, n=N, ppc=PPC):
    ctes = SC.sql_task_statements(task, n, ppc, SEED)
    return with_ctes(SC.views_for([task]), ctes, f"select * from t_{task}_st")


def _span(spark, root):
    """C8 with the flag of negatives that hold (part of) an answer."""
    rows = sample_tasks(V(spark, root), ["squad"], N, SEED, write=False)["squad"]
    return B.build_span(rows, "squad", template_choice(SEED, "squad", RECIPES["squad"].template_set, PPC)["all"], "context", "question", seed=SEED, flag=True)


def _span_sql():
    # characters from the span's first less one answer length to its last and one answer length more
    near = "substring(context, greatest(st - length(a) + 1, 0) + 1, st + span + length(a) - 1 - greatest(st - length(a) + 1, 0))"
    flag = f"not pos and span > 0 and len(list_filter(answers.text, lambda a: length(a) > 0 and instr({near}, a) > 0)) > 0"
    ctes = SC.sql_task_statements("squad", N, PPC, SEED)
    ctes.append(("flagged", f"select sample_idx, coalesce({flag}, false) as is_suspect_negative from t_squad_x4"))
    return with_ctes(SC.views_for(["squad"]), ctes, "select s.*, f.is_suspect_negative from t_squad_st s join flagged f using (sample_idx)")


register("build_span", _span_sql())(_span)
del BUILDER_KEYS["build_span"]

for _key, _task in BUILDER_KEYS.items():
    register(_key, _task_statements_sql(_task))(
        (lambda t: (lambda spark, root: task_statements(V(spark, root), t, N, PPC, SEED)))(_task)
    )


def _fill_df(spark, root):
    qa = V(spark, root).qa()
    tpl = 'Q: ${1} -> ${2} (asked: "${1}")'
    return qa.select("id", fill_template(tpl, [F.col("question"), F.col("answer")]).alias("statement"))


register(
    "fill_template",
    with_ctes(["V_qa"], [], (
        "select id, replace(replace('Q: ${1} -> ${2} (asked: \"${1}\")', '${1}', question), '${2}', answer) as statement from V_qa"
    )),
)(_fill_df)


def _nogold(spark, root):
    nli = V(spark, root).nli()
    return nli.agg(
        F.count(F.when(F.col("label") >= 0, 1)).alias("kept"), F.count(F.when(F.col("label") < 0, 1)).alias("dropped")
    )


register(
    "build_class_template_nogold",
    with_ctes(["V_nli"], [], "select count(case when label >= 0 then 1 end) as kept, count(case when label < 0 then 1 end) as dropped from V_nli"),
)(_nogold)

# =============================================================================================
# corpus
# =============================================================================================

RECIPE_EXCLUDE = "samsum,wikilingua,,offensive"


def _corpus_sql(exclude=None, n=N, ppc=PPC, spc=SPC, select="*"):
    from claimforge.operators.corpus import TASKS, parse_exclude

    ex = set(parse_exclude(exclude))
    tasks = [t for t in TASKS if t not in ex]
    ctes = []
    for t in tasks:
        ctes += SC.sql_task_corpus(t, n, ppc, spc, SEED)
    union = " union all ".join(f"select * from t_{t}_corpus" for t in tasks)
    ctes.append(("corpus", union))
    return with_ctes(SC.views_for(tasks), ctes, f"select {select} from corpus")


register("corpus_recipe", _corpus_sql(RECIPE_EXCLUDE))(
    lambda spark, root: build_corpus(V(spark, root), RECIPE_EXCLUDE, N, PPC, SPC, SEED)
)
register("concat_corpus", _corpus_sql(None))(lambda spark, root: build_corpus(V(spark, root), None, N, PPC, SPC, SEED))
register(
    "corpus_profile",
    _corpus_sql(None).replace(
        "select * from corpus",
        "select task, count(*) as n_statements, cast(sum(is_true) as bigint) as n_true, round(avg(is_true), 6) as share_true "
        "from corpus group by task",
    ),
)(lambda spark, root: corpus_profile(corpus_keys(V(spark, root), None, N, PPC, SPC, SEED)))

# =============================================================================================
# B: sampling
# =============================================================================================


def _b1(spark, root):
    return S.sample_exact(V(spark, root).docs().select("id", "lang"), 300, SEED, "b1")


register(
    "sample_exact",
    with_ctes(["V_docs"], [], (
        f"select id, lang, id as sample_idx from (select id, lang, row_number() over (order by {sql_hash(SEED, 'b1', 'id')}, id) as rn "
        f"from V_docs) where rn <= 300"
    )),
)(_b1)


def _b2(spark, root):
    qa = V(spark, root).qa().select("id", "question")
    return S.bootstrap_exact(qa, 3000, qa.count(), SEED, "b2")


register(
    "bootstrap_exact",
    with_ctes(["V_qa"], [("src", "select id, question from V_qa")] + SC.sql_resize("b2", "src", 3000, SEED, "b2"),
              "select id, question, sample_idx from b2_s2"),
)(_b2)


def _b3(spark, root):
    v = V(spark, root)
    a = S.resize_to_n(v.bin().select("id", "label"), 1000, SEED, "b3a").withColumn("part", F.lit("bin"))
    b = S.resize_to_n(v.choice().select("id", "label"), 1000, SEED, "b3b").withColumn("part", F.lit("choice"))
    return a.unionByName(b)


register(
    "resize_to_n",
    with_ctes(
        ["V_bin", "V_choice"],
        [("sa", "select id, label from V_bin"), ("sb", "select id, label from V_choice")]
        + SC.sql_resize("ra", "sa", 1000, SEED, "b3a") + SC.sql_resize("rb", "sb", 1000, SEED, "b3b"),
        "select *, 'bin' as part from ra_samp union all select *, 'choice' as part from rb_samp",
    ),
)(_b3)

register(
    "stratified_exact",
    with_ctes(SC.views_for(["qqp"]), SC.sql_task_corpus("qqp", N, PPC, SPC, SEED), "select * from t_qqp_corpus"),
)(lambda spark, root: task_corpus(V(spark, root), "qqp", N, PPC, SPC, SEED))


def _b5(spark, root):
    st = task_statements(V(spark, root), "qqp", 2000, 2, SEED)
    return st.groupBy("template_id").agg(F.count(F.lit(1)).alias("n_statements"))


register(
    "template_subset",
    with_ctes(SC.views_for(["qqp"]), SC.sql_task_statements("qqp", 2000, 2, SEED),
              "select template_id, count(*) as n_statements from t_qqp_st group by template_id"),
)(_b5)


def _b6(spark, root):
    d = V(spark, root).docs().select("id").withColumnRenamed("id", "sample_idx")
    pos = B.is_positive(SEED, "b6")
    return d.select("sample_idx", F.when(pos, "positive").otherwise("negative").alias("polarity"))


register(
    "polarity_draw",
    with_ctes(["V_docs"], [], (
        f"select id as sample_idx, case when {sql_draw(SEED, 'pol:b6', 'id')} % 2 = 0 then 'positive' else 'negative' end "
        f"as polarity from V_docs"
    )),
)(_b6)


def _b7(spark, root):
    c = V(spark, root).choice().select(F.col("id").alias("sample_idx"), "option1", "option2")
    opt = draw_mod(SEED, "opt:b7", 2, "sample_idx")
    return c.select("sample_idx", opt.alias("opt"), F.element_at(F.array("option1", "option2"), opt.cast("int") + 1).alias("answer"))


register(
    "choice_draw",
    with_ctes(["V_choice"], [], (
        f"select sample_idx, opt, [option1, option2][opt + 1] as answer from (select id as sample_idx, option1, option2, "
        f"{sql_draw(SEED, 'opt:b7', 'id')} % 2 as opt from V_choice)"
    )),
)(_b7)


def _b8(spark, root):
    m = V(spark, root).multi().select(F.col("id").alias("sample_idx"), "label")
    return m.select("sample_idx", "label", B.pick_wrong(SEED, "b8", 4, F.col("label").cast("int")).alias("wrong"))


register(
    "wrong_class_draw",
    with_ctes(["V_multi"], [], (
        f"select sample_idx, label, r + case when r >= label then 1 else 0 end as wrong from (select id as sample_idx, label, "
        f"{sql_draw(SEED, 'b8', 'id')} % 3 as r from V_multi)"
    )),
)(_b8)

register("head_n", with_ctes(["V_docs"], [], "select id, lang from V_docs order by id limit 100"))(
    lambda spark, root: S.head_n(V(spark, root).docs().select("id", "lang"), 100)
)


def _b10(spark, root):
    st = task_statements(V(spark, root), "qqp", N, PPC, SEED)
    return S.split_flag(st, 0.1, SEED, "b10", ["sample_idx", "template_id"])


def _b10_sql():
    ctes = SC.sql_task_statements("qqp", N, PPC, SEED)
    ctes.append(("rk", (
        f"select *, row_number() over (order by {sql_hash(SEED, 'b10', 'sample_idx', 'template_id')}, sample_idx, template_id) "
        f"as rn_ from t_qqp_st"
    )))
    return with_ctes(SC.views_for(["qqp"]), ctes, (
        "select * exclude (rn_), rn_ <= ceil(0.1 * (select count(*) from t_qqp_st)) as is_test from rk"
    ))


register("train_val_split", _b10_sql())(_b10)


def _few_shot(df, n_shot, salt, label="label"):
    n = df.count()
    k = min(n_shot, n - 2)
    return S.stratified_exact(df, k, SEED, salt, ["id"], label)


def _b11(spark, root):
    return _few_shot(V(spark, root).copa().select("id", "label"), 32, "b11")


def _strat_sql(view, cols, total_expr, salt, label="label", prefix="st"):
    ctes = [("src", f"select {cols} from {view}")]
    ctes += SC.sql_stratified(prefix, "src", total_expr, SEED, salt, ["id"], label)
    return ctes


register(
    "few_shot_sample",
    with_ctes(["V_copa"], [("n_src", "select count(*) as n from V_copa")]
              + [("src", "select id, label, least(32, (select n from n_src) - 2) as req from V_copa")]
              + SC.sql_stratified("st", "src", "req", SEED, "b11", ["id"], "label"),
              "select id, label from st_take"),
)(_b11)

SHOTS = [32, 200, 500, 1000]


def _b11_sets(spark, root):
    """The few-shot sets of all shot settings, of three evaluation sets."""
    v = V(spark, root)
    frames = {"copa": v.copa(), "mrpc": v.pairs(), "emotion": v.emotion()}
    return S.union_all([
        S.few_shot_sets(df.select("id", "label"), SHOTS, SEED, f"b11:{name}").withColumn("dataset", F.lit(name)) for name, df in frames.items()
    ])


def _b11_sets_sql():
    views, ctes, parts = [], [], []
    for name, view in (("copa", "V_copa"), ("mrpc", "V_pairs"), ("emotion", "V_emotion")):
        views.append(view)
        ctes.append((f"n_{name}", f"select count(*) as n from {view}"))
        for shot in SHOTS:
            p = f"fs_{name}_{shot}"
            ctes.append((f"{p}_src", f"select id, label, least({shot}, greatest((select n from n_{name}) - 2, 0)) as req from {view}"))
            ctes += SC.sql_stratified(p, f"{p}_src", "req", SEED, f"b11:{name}", ["id"], "label")
            parts.append(f"select {shot} as shot, id, label, '{name}' as dataset from {p}_take")
    return with_ctes(views, ctes, " union all ".join(parts))


register("few_shot_sets", _b11_sets_sql())(_b11_sets)


def _b12(spark, root):
    s = V(spark, root).story().select("id", (F.col("answer_right_ending") - 1).alias("label"))
    return S.stratified_split(s, 32, SEED, "b12", ["id"], "label")


register(
    "stratified_split",
    with_ctes(["V_story"], [("src", "select id, answer_right_ending - 1 as label from V_story")]
              + SC.sql_stratified("st", "src", 32, SEED, "b12", ["id"], "label"),
              "select s.id, s.label, coalesce(t.id is not null, false) as is_train from src s left join st_take t using (id)"),
)(_b12)


def _b13(spark, root):
    m = V(spark, root).multi().select("id", "label")
    n = m.count()
    return S.stratified_exact(m, min(2000, n - 2), SEED, "b13", ["id"], "label")


register(
    "stratified_test_cap",
    with_ctes(["V_multi"], [("src", "select id, label, least(2000, (select count(*) from V_multi) - 2) as req from V_multi")]
              + SC.sql_stratified("st", "src", "req", SEED, "b13", ["id"], "label"),
              "select id, label from st_take"),
)(_b13)

register(
    "uniform_20",
    with_ctes(["V_pairs"], [], (
        f"select id, text1 from (select id, text1, row_number() over (order by {sql_hash(SEED, 'b14', 'id')}, id) as rn "
        f"from V_pairs) where rn <= 20"
    )),
)(lambda spark, root: S.uniform_n(V(spark, root).pairs().select("id", "text1"), 20, SEED, "b14"))
