"""Run aggregation (G), reshaping / statistics (H) and result-table filters and formats (E).

The result table is derived from the run records (``V_runs``): per-model summaries
(G1) pooled over models (G2) - the same shape as the reference's result CSVs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.functions.text import model_short_name, parse_percent, word_count
from claimforge.operators import reshape as R
from claimforge.operators.hooks import max_token_filter
from claimforge.operators import runs as G
from claimforge.operators.corpus import parse_exclude
from claimforge.plans.base import V, register
from claimforge.plans.q_eval import random_rows
from claimforge.plans.sqlviews import q, with_ctes

RUN_DATASETS = ["click", "error", "purchase", "signup", "view"]
KEYS = G.RESULT_KEYS
KEYS_SQL = ", ".join(KEYS)



def em(x: str) -> str:
    """SQL twin of ``exact_mean``."""
    return f"(cast(sum(cast({x} as decimal(38,9))) as double) / nullif(count({x}), 0))"


G1_SQL = (
    f"select model_no, {KEYS_SQL}, {em('accuracy')} as Mean, stddev_samp(accuracy) as std, {em('n_examples / seconds')} as speed "
    f"from V_runs group by model_no, {KEYS_SQL}"
)
RES_SQL = (
    f"select {KEYS_SQL}, {em('Mean')} as Mean, case when count(std) < count(*) then null else sqrt(avg(std * std)) end as std, "
    f"{em('speed')} as speed from g1 group by {KEYS_SQL}"
)
RUN_CTES = [("g1", G1_SQL), ("res", RES_SQL)]


def rsql(body: str, extra=(), views=("V_runs",)) -> str:
    return with_ctes(list(views), RUN_CTES + list(extra), body)


def r6(df, cols=("std",)):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def R6(cols, src_cols):
    return ", ".join(f"round({c}, 6) as {c}" if c in cols else c for c in src_cols)


def g1(spark, root):
    return G.run_summary(V(spark, root).runs())


def results(spark, root):
    return G.pooled_summary(g1(spark, root))


G1_COLS = ["model_no"] + KEYS + ["Mean", "std", "speed"]
RES_COLS = KEYS + ["Mean", "std", "speed"]
MS = ("std",)

# ---- G ---------------------------------------------------------------------------------------------

register("run_summary", rsql(f"select {R6(MS, G1_COLS)} from g1"))(lambda s, r: r6(g1(s, r)))
register("pooled_summary", rsql(f"select {R6(MS, RES_COLS)} from res"))(lambda s, r: r6(results(s, r)))
register(
    "pooled_std",
    rsql("select model, dataset, round(case when count(std) < count(*) then null else sqrt(avg(std * std)) end, 6) as pooled_std "
         "from g1 group by model, dataset"),
)(lambda s, r: g1(s, r).groupBy("model", "dataset").agg(F.round(G.pooled_std("std"), 6).alias("pooled_std")))

_G4 = ["model", "shot", "SPC", "PPC", "excluded"]
register(
    "macro_average",
    rsql(f"select {', '.join(_G4)}, {em('Mean')} as macro_Mean from res group by {', '.join(_G4)}"),
)(lambda s, r: G.macro_average(results(s, r), _G4))


def _first_std_sql(how):
    agg = "max(Mean)" if how == "max" else em("Mean")
    return rsql(
        f"select m.dataset, m.Mean, round(s.std, 6) as std from (select dataset, {agg} as Mean from f group by dataset) m "
        "left join s on s.dataset = m.dataset and s.rn = 1",
        [("f", "select * from res where shot = '32'"),
         ("s", "select dataset, std, row_number() over (partition by dataset order by SPC, model, coalesce(excluded, '')) as rn "
               "from f where std is not null")],
    )


def _first_std(how):
    def q_(s, r):
        res = results(s, r).filter(F.col("shot") == "32")
        return r6(G.group_first_std(res, how), ("std",))

    return q_


register("group_max_first", _first_std_sql("max"))(_first_std("max"))
register("group_mean_first", _first_std_sql("mean"))(_first_std("mean"))


def _g7(s, r):
    res = results(s, r).filter(F.col("excluded").isNull())
    cells = res.groupBy("SPC", "dataset").pivot("model", ["org/base", "large"]).agg(G.exact_mean("Mean"))
    return cells.groupBy("SPC").agg(
        G.exact_mean(F.col("`org/base`")).alias("base_mean"), G.exact_mean("large").alias("large_mean")
    )


register(
    "mean_of_means",
    rsql(f"select SPC, {em('b')} as base_mean, {em('l')} as large_mean from (select SPC, dataset, "
         + em("case when model = 'org/base' then Mean end") + " as b, " + em("case when model = 'large' then Mean end") + " as l "
         "from res where excluded is null group by SPC, dataset) group by SPC"),
)(_g7)


def _g8(s, r):
    return results(s, r).groupBy("shot").pivot("dataset", RUN_DATASETS).agg(G.exact_mean("Mean"))


register(
    "mean_cells",
    rsql("select shot, " + ", ".join(f"{em(f'case when dataset = {q(d)} then Mean end')} as {d}" for d in RUN_DATASETS)
         + " from res group by shot"),
)(_g8)

register("distinct_values", rsql("select distinct dataset from res"))(lambda s, r: G.distinct_values(results(s, r), "dataset"))

# ---- H ---------------------------------------------------------------------------------------------


def _h1(s, r):
    res = results(s, r).filter((F.col("shot") == "0") & (F.col("PPC") == 5) & (F.col("model") == "org/base"))
    res = res.withColumn("excluded", F.coalesce("excluded", F.lit("None"))).withColumn("x", F.col("Mean") * 100)
    return res.groupBy("excluded").pivot("dataset", RUN_DATASETS).agg(G.exact_mean("x"))


_H1_F = "select coalesce(excluded, 'None') as excluded, dataset, Mean * 100 as x, std * 100 as sx from res where shot = '0' and PPC = 5 and model = 'org/base'"
register(
    "pivot_excluded",
    rsql("select excluded, " + ", ".join(f"{em(f'case when dataset = {q(d)} then x end')} as {d}" for d in RUN_DATASETS)
         + " from h1 group by excluded", [("h1", _H1_F)]),
)(_h1)

SHOT_COLS = {"full_shot": "full", "shot_1000": "1000", "shot_0": "0"}


def _melted(s, r):
    wb = V(s, r).wide_baseline()
    m = R.melt(wb, ["eval_set", "model"], list(SHOT_COLS), "shot", "accuracy")
    return m.withColumn("shot", R.recode("shot", SHOT_COLS))


_MELT_SQL = " union all ".join(
    f"select eval_set, model, {q(v)} as shot, {c} as accuracy from V_wide_baseline" for c, v in SHOT_COLS.items()
)
register("melt_wide", with_ctes(["V_wide_baseline"], [], _MELT_SQL))(_melted)

register(
    "dedup_first",
    rsql(f"select {R6(MS, G1_COLS)} from (select *, row_number() over (partition by {KEYS_SQL} order by model_no) as rn_ from g1) where rn_ = 1"),
)(lambda s, r: r6(R.dedup_first(g1(s, r), KEYS, ["model_no"])))

register(
    "dedup_none",
    rsql(f"select {R6(MS, G1_COLS)} from (select *, count(*) over (partition by {KEYS_SQL}) as c_ from g1) where c_ = 1"),
)(lambda s, r: r6(R.dedup_none(g1(s, r), KEYS)))

register("sort_runs", rsql(f"select {R6(MS, RES_COLS)} from res"))(
    lambda s, r: r6(results(s, r).orderBy(R.shot_order("shot"), "SPC", "dataset", "model", F.col("excluded").asc_nulls_first()))
)


def _h6(s, r):
    rb = random_rows(s, r).select("dataset", "model", F.col("accuracy").alias("Mean"))
    return r6(results(s, r).unionByName(rb, allowMissingColumns=True))


register(
    "union_rows",
    rsql(
        f"select {R6(MS, RES_COLS)} from (select * from res union all by name select dataset, 'random' as model, Mean from rb)",
        [("rb", "select dataset, CAST(1 AS DOUBLE) / k as Mean from (values ('copa', 2), ('mrpc', 2), ('amazon_p', 2), ('figqa', 2), "
                "('storycloze', 2), ('yahoo', 10), ('emotion', 6)) t(dataset, k)")],
    ),
)(_h6)


def _baseline(s, r):
    m = _melted(s, r).filter(F.col("model") == "base")
    return m.select("shot", F.col("eval_set").alias("dataset"), parse_percent("accuracy").alias("accuracy"))


def _h7(s, r):
    out = R.baseline_delta(results(s, r), _baseline(s, r))
    return r6(out)


_BASE_SQL = (
    f"select shot, eval_set as dataset, try_cast(regexp_replace(accuracy, '%+$', '') as double) / 100 as accuracy "
    f"from ({_MELT_SQL}) where model = 'base'"
)
register(
    "baseline_delta",
    rsql(
        f"select {R6(MS, RES_COLS + ['delta'])} from (select r.*, r.Mean - b.accuracy as delta from res r left join "
        f"(select * from (select *, row_number() over (partition by shot, dataset order by accuracy nulls last) as rn_ from bl) where rn_ = 1) b "
        f"using (shot, dataset))",
        [("bl", _BASE_SQL)],
        ["V_runs", "V_wide_baseline"],
    ),
)(_h7)

# H8 smoothing + E12 band


def _series(s, r):
    res = results(s, r).filter(
        (F.col("model") == "org/base") & (F.col("PPC") == 5) & F.col("excluded").isNull() & F.col("Mean").isNotNull()
    )
    return res.select("dataset", "shot", "SPC", "Mean", "std")


def _h8(s, r):
    out = R.savgol(_series(s, r), ["dataset", "shot"], "SPC", "Mean", 7, 5, places=6)
    return r6(out, ("std",))


# The oracle states the weights of a fit to seven points itself.  Degree 5 leaves out the sixth difference
# (1, -6, 15, -20, 15, -6, 1), of square 924; degree 3 is the table of the cubic, over 42.
_SIXTH = [1, -6, 15, -20, 15, -6, 1]
_CUBIC = [
    [39, 8, -4, -4, 1, 4, -2],
    [8, 19, 16, 6, -4, -7, 4],
    [-4, 16, 19, 12, 2, -4, 1],
    [-4, 6, 12, 14, 12, 6, -4],
    [1, -4, 2, 12, 19, 16, -4],
    [4, -7, -4, 6, 16, 19, 8],
    [-2, 4, 1, -4, -4, 8, 39],
]


def _savgol_sql(order: int):
    weights, below = (_CUBIC, 42) if order == 3 else ([[924 * (i == k) - a * b for k, b in enumerate(_SIXTH)] for i, a in enumerate(_SIXTH)], 924)
    hat = ", ".join(f"({i}, {k}, {v})" for i, row in enumerate(weights) for k, v in enumerate(row))
    unit = below * 1000  # of sums of values at 9 places, for 6 places
    return [
        ("sg0", "select dataset, shot, SPC, Mean, std from res where model = 'org/base' and PPC = 5 and excluded is null and Mean is not null"),
        ("sg1", "select *, row_number() over (partition by dataset, shot order by SPC) - 1 as i, count(*) over (partition by dataset, shot) as n from sg0"),
        ("sg2", "select *, least(greatest(i - 3, 0), n - 7) as base from sg1"),
        ("hat", f"select * from (values {hat}) t(r, k, w)"),
        ("sg3", (
            "select a.dataset, a.shot, a.SPC, sum(h.w * cast(round(b.Mean * 1000000000) as bigint)) as sm from sg2 a join hat h on h.r = a.i - a.base "
            "join sg1 b on b.dataset = a.dataset and b.shot = a.shot and b.i = a.base + h.k where a.n >= 7 "
            "group by a.dataset, a.shot, a.SPC"
        )),
        ("sg4", (
            f"select a.dataset, a.shot, a.SPC, a.Mean, a.std, sign(s.sm) * cast((2 * abs(s.sm) + {unit}) // {2 * unit} as double) / 1000000 as Mean_smoothed "
            "from sg1 a left join sg3 s using (dataset, shot, SPC)"
        )),
    ]


register(
    "savgol_smooth",
    rsql("select dataset, shot, SPC, Mean, round(std, 6) as std, Mean_smoothed from sg4",
         _savgol_sql(5)),
)(_h8)


def _h8_deltas(s, r):
    """Smoothing of the deltas to the baseline, with a cubic fit."""
    deltas = R.baseline_delta(results(s, r), _baseline(s, r)).filter(
        (F.col("model") == "org/base") & (F.col("PPC") == 5) & F.col("excluded").isNull() & F.col("delta").isNotNull()
    )
    out = R.savgol(deltas.select("dataset", "shot", "SPC", "delta"), ["dataset", "shot"], "SPC", "delta", 7, 3, places=6)
    return r6(out, ("delta",))


register(
    "savgol_smooth_deltas",
    rsql("select dataset, shot, SPC, round(Mean, 6) as delta, Mean_smoothed as delta_smoothed from sg4",
         [("bl", _BASE_SQL),
          ("dl", "select r.dataset, r.shot, r.SPC, r.Mean - b.accuracy as Mean, r.std from res r join (select * from (select *, row_number() over "
                 "(partition by shot, dataset order by accuracy nulls last) as rn_ from bl) where rn_ = 1) b using (shot, dataset) "
                 "where r.model = 'org/base' and r.PPC = 5 and r.excluded is null and r.Mean - b.accuracy is not null")]
         + [("sg0", "select * from dl"), *_savgol_sql(3)[1:]],
         ["V_runs", "V_wide_baseline"]),
)(_h8_deltas)


def _e12(s, r):
    sm = R.savgol(_series(s, r), ["dataset", "shot"], "SPC", "Mean", 7, 5, places=6)
    out = R.confidence_band(sm, "Mean_smoothed", "std")
    return r6(out.select("dataset", "shot", "SPC", "Mean_smoothed", "upper", "lower"), ("upper", "lower"))


register(
    "confidence_band",
    rsql("select dataset, shot, SPC, Mean_smoothed, round(Mean_smoothed + std, 6) as upper, "
         "round(Mean_smoothed - std, 6) as lower from sg4", _savgol_sql(5)),
)(_e12)


def _h9(s, r):
    res = results(s, r).filter((F.col("model") == "org/base") & (F.col("PPC") == 5) & F.col("excluded").isNull())
    out = R.shot_correlation(res)
    return out.withColumn("corr", F.round("corr", 6))


register(
    "shot_correlation",
    rsql(
        "select a.shot as shot_a, b.shot as shot_b, round(case when count(*) >= 2 and stddev_pop(a.v) > 0 and stddev_pop(b.v) > 0 "
        "then corr(a.v, b.v) end, 6) as corr, count(*) as n_cells from cells a join cells b on a.SPC = b.SPC and a.dataset = b.dataset "
        "group by a.shot, b.shot",
        [("cells", "select SPC, dataset, shot, avg(Mean) as v from res where model = 'org/base' and PPC = 5 and excluded is null "
                   "and shot in ('0', '32', '200', '500', 'full') group by SPC, dataset, shot")],
    ),
)(_h9)


def _h10_11(fn, col):
    def q_(s, r):
        res = results(s, r).filter((F.col("shot") == "0") & (F.col("PPC") == 5) & (F.col("model") == "org/base"))
        res = res.withColumn("excluded", F.coalesce("excluded", F.lit("None"))).withColumn("x", F.col(col) * 100)
        return res.groupBy("excluded").agg(F.round(fn("x"), 6).alias("value"))

    return q_


register(
    "row_gmean",
    rsql("select excluded, round(case when count(x) < count(*) then null when min(x) < 0 then null when min(x) = 0 then 0.0::double "
         "else exp(avg(ln(case when x > 0 then x end))) end, 6) as value from h1 group by excluded", [("h1", _H1_F)]),
)(_h10_11(R.gmean, "Mean"))
register(
    "row_rms",
    rsql("select excluded, round(case when count(x) < count(*) then null else sqrt(avg(x * x)) end, 6) as value "
         "from (select excluded, sx as x from h1) group by excluded", [("h1", _H1_F)]),
)(_h10_11(R.rms, "std"))

SPEED_COLS = ["click", "view", "error"]
_ROWMEAN_SQL = (
    "(coalesce(click, 0) + coalesce(view, 0) + coalesce(error, 0)) / nullif(cast(click is not null as int) + "
    "cast(view is not null as int) + cast(error is not null as int), 0)"
)
register(
    "row_mean",
    with_ctes(["V_speed_wide"], [], f"select model, round({_ROWMEAN_SQL}, 6) as avg_speed from V_speed_wide"),
)(lambda s, r: V(s, r).speed_wide().select("model", F.round(R.row_mean(SPEED_COLS), 6).alias("avg_speed")))


def _speed_table(s, r):
    sw = V(s, r).speed_wide()
    t = sw.select(
        model_short_name("model").alias("model"),
        F.col("click").alias("Click"), F.col("view").alias("View"), F.col("error").alias("Error"),
        R.row_mean(SPEED_COLS).alias("Avg"),
    )
    return t.orderBy(F.col("Click").asc_nulls_first())


register(
    "speed_table",
    with_ctes(["V_speed_wide"], [], (
        f"select string_split(model, '/')[2] as model, round(click, 6) as Click, round(view, 6) as View, round(error, 6) as Error, "
        f"round({_ROWMEAN_SQL}, 6) as Avg from V_speed_wide"
    )),
)(lambda s, r: r6(_speed_table(s, r), ("Click", "View", "Error", "Avg")))


def _h14(s, r):
    t = _speed_table(s, r)
    return R.latex_rows(t, ["model"], ["Click", "View", "Error", "Avg"]).select("model", "line")


_fmt = lambda c: f"coalesce(format('{{:,.1f}}', {c}), 'nan')"
register(
    "latex_rows",
    with_ctes(["V_speed_wide"], [], (
        f"select string_split(model, '/')[2] as model, concat_ws(' & ', coalesce(string_split(model, '/')[2], ''), "
        f"{_fmt('click')}, {_fmt('view')}, {_fmt('error')}, {_fmt(_ROWMEAN_SQL)}) as line from V_speed_wide"
    )),
)(_h14)

# ---- E ---------------------------------------------------------------------------------------------


def _e1(s, r):
    v = V(s, r)
    d = v.docs().select("id")
    lab = v.table("labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("is_true"))
    return d.join(lab, "id", "left").filter(F.col("is_true").isNotNull())


register(
    "drop_null_label",
    with_ctes(["V_docs"], [], "select d.id, l.toxic as is_true from V_docs d left join labels l on l.doc_id = d.id where l.toxic is not null"),
)(_e1)

MAX_TOKENS = 514 + 20


def _e2(s, r):
    d = V(s, r).table("documents").select("doc_id", "text")
    return max_token_filter(d, "text", MAX_TOKENS, word_count, "n_words").drop("text")


register(
    "max_token_filter",
    "select doc_id, n_words from (select doc_id, cast(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), "
    f"lambda w: w <> '')) as bigint) as n_words from documents) where n_words < {MAX_TOKENS}",
)(_e2)

EXCLUDE_LIST = "click,,signup"


def _e3(s, r):
    ex = parse_exclude(EXCLUDE_LIST)
    return r6(results(s, r).filter(~F.col("dataset").isin(ex)))


register(
    "exclude_tasks",
    rsql(f"select {R6(MS, RES_COLS)} from res where dataset not in (" + ", ".join(q(x) for x in parse_exclude(EXCLUDE_LIST)) + ")"),
)(_e3)

register(
    "filter_runs",
    rsql(f"select {R6(MS, RES_COLS)} from res where model = 'org/base' and PPC = 5 and excluded is null and std is not null"),
)(lambda s, r: r6(results(s, r).filter(
    (F.col("model") == "org/base") & (F.col("PPC") == 5) & F.col("excluded").isNull() & F.col("std").isNotNull())))

register(
    "drop_where",
    rsql(f"select {R6(MS, RES_COLS)} from res where not (dataset is not distinct from 'error' and shot is not distinct from 'full')"),
)(lambda s, r: r6(results(s, r).filter(~(F.col("dataset").eqNullSafe("error") & F.col("shot").eqNullSafe("full")))))

SET_NAMES = {"purchase": "buy", "signup": "join"}


def _e6(s, r):
    res = results(s, r)
    return r6(res.select(
        R.recode("shot", R.SHOT_RECODE).alias("shot"), R.recode("SPC", R.SPC_LABELS).alias("SPC_label"),
        R.recode("dataset", SET_NAMES).alias("dataset"), "model", "PPC", "excluded", "Mean", "std", "speed"))


_spc_case = "case SPC " + " ".join(f"when {k} then {q(v)}" for k, v in R.SPC_LABELS.items()) + " else cast(SPC as varchar) end"
_set_case = "case dataset " + " ".join(f"when {q(k)} then {q(v)}" for k, v in SET_NAMES.items()) + " else dataset end"
register(
    "recode_values",
    rsql(f"select case shot when 'full' then 'full/3000' else shot end as shot, {_spc_case} as SPC_label, {_set_case} as dataset, "
         "model, PPC, excluded, Mean, round(std, 6) as std, speed from res"),
)(_e6)


def _e7(s, r):
    wb = V(s, r).wide_baseline()
    return wb.select("eval_set", *[parse_percent(c).alias(c) for c in SHOT_COLS])


register(
    "parse_percent",
    with_ctes(["V_wide_baseline"], [], "select eval_set, " + ", ".join(
        f"try_cast(regexp_replace({c}, '%+$', '') as double) / 100 as {c}" for c in SHOT_COLS) + " from V_wide_baseline"),
)(_e7)


def _e8(s, r):
    res = results(s, r)
    return r6(res.select(F.lower("model").alias("model"), F.col("dataset").alias("eval_set"), "shot", "SPC",
                         (F.col("Mean") * 100).alias("Mean"), (F.col("std") * 100).alias("std"), F.lit("claims").alias("source")))


register(
    "scale_lower_rename",
    rsql("select lower(model) as model, dataset as eval_set, shot, SPC, Mean * 100 as Mean, round(std * 100, 6) as std, "
         "'claims' as source from res"),
)(_e8)

register(
    "fill_missing",
    rsql(f"select {', '.join(c if c != 'excluded' else 'coalesce(excluded, ' + q('None') + ') as excluded' for c in KEYS)}, "
         "Mean, round(std, 6) as std, speed from res"),
)(lambda s, r: r6(results(s, r).withColumn("excluded", F.coalesce("excluded", F.lit("None")))))

register(
    "model_short_name",
    with_ctes(["V_speed_wide"], [], "select model, string_split(model, '/')[2] as short_name from V_speed_wide"),
)(lambda s, r: V(s, r).speed_wide().select("model", model_short_name("model").alias("short_name")))


def _e11(s, r):
    res = results(s, r).withColumn("m", F.col("Mean") * 100).withColumn("sd", F.col("std") * 100)
    return res.select(*KEYS, R.format_cell("m", "sd").alias("cell"))


register(
    "format_cell",
    rsql(f"select {KEYS_SQL}, concat({_fmt('Mean * 100')}, '$_{{(', {_fmt('std * 100')}, ')}}$') as cell from res"),
)(_e11)
