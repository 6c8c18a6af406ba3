"""Corpus assembly (C15, A7, I6): sample -> build -> stratified cap -> tag, all tasks in one pass each.

Tasks are sampled together (``sample_tasks``): one count, one histogram and one table of picked ids for
all of them, and one read of a view for all tasks that share it.  Selections over statements work on keys
(task, sample, template); the texts of what was selected are filled in at the end, from the sampled rows.

A recipe names the stand-in view of a task, how its rows are shaped into the
builder's input columns, an optional pre-sample filter and the builder.  Excluded
tasks are never planned, so their sources are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.functions.draws import hex_to_u32
from claimforge.operators import builders as B
from claimforge.operators.sampling import dense_rank, stratified_exact, take_first, union_all
from claimforge.operators.templates import CLASS_NAMES, TRAIN_TEMPLATES, choose_templates
from claimforge.session import materialize as materialize_df
from claimforge.sources.standins import TaskViews

DEFAULT_N = 10000  # rows per task before template expansion (resize target)
BROADCAST_ROWS = 1_000_000  # picked ids that are broadcast to a view; beyond, Spark plans the join


@dataclass
class Recipe:
    task: str
    view: str  # TaskViews method name
    template_set: str
    prep: Callable[[DataFrame], DataFrame]
    build: Callable[..., DataFrame]
    pre_filter: Callable[[DataFrame], DataFrame] | None = None
    options: dict = field(default_factory=dict)


def template_choice(seed, task, template_set, ppc):
    groups = TRAIN_TEMPLATES[template_set]
    return {g: choose_templates(seed, task, g, ts, ppc) for g, ts in groups.items()}


def _ident(df):
    return df


def _own(df) -> list[str]:
    """The row's id, and what the sample gave it."""
    return [c for c in ("id", "sample_idx", "source_id") if c in df.columns]


def _prep_piqa(df):
    return df.select(*_own(df), F.col("sentence").alias("goal"), F.col("option1").alias("sol1"),
                     F.col("option2").alias("sol2"), "label")


def _prep_span(df):
    return df.select(*_own(df), "context", "question", F.struct(F.array("answer_text").alias("text")).alias("answers"))


def _prep_sub(df):
    return df.select(*_own(df), "sentence", "pronoun", F.array("cand0", "cand1").alias("candidates"), "label")


def _prep_letter(df):
    texts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.concat(F.col("choice_stem"), F.lit("-"), k.cast("string")))
    return df.select(*_own(df), "question", "formatted_question", "combinedfact", F.struct(texts.alias("text")).alias("choices"),
                     "answerKey")


def _prep_cloze(df):
    return df.select(*_own(df), "article", "question", F.array("opt_a", "opt_b", "opt_c", "opt_d").alias("options"), "answer")


def _build(task, recipe: Recipe, df, ch, seed, n):
    b = recipe.build
    if b is B.build_pair_compare:
        return b(df, task, ch["pos"], ch["neg"], ["text1", "text2"], "label", seed=seed)
    if b is B.build_multiple_choice:
        o = recipe.options
        return b(df, task, ch["all"], o["question"], o["answers"], o["label"], o.get("offset", 0), o.get("blank_fill", False), seed=seed)
    if b is B.build_class_template:
        by_class = [ch[str(c)] for c in range(len(ch))]
        return b(df, task, by_class, recipe.options["columns"], "label", seed=seed)
    if b is B.build_shifted_answer:
        return b(df, task, ch["all"], "question", "answer", n, seed=seed)
    if b is B.build_span:
        return b(df, task, ch["all"], "context", "question", "answers", seed=seed)
    if b is B.build_binary_class:
        return b(df, task, ch["all"], "text", CLASS_NAMES[recipe.options["names"]], "label", seed=seed)
    if b is B.build_multi_class:
        return b(df, task, ch["all"], "text", CLASS_NAMES[recipe.options["names"]], "label", seed=seed)
    if b is B.build_substitution:
        return b(df, task, ch["all"], "sentence", "pronoun", "candidates", "label", seed=seed)
    if b is B.build_lettered_choice:
        return b(df, task, ch, seed=seed)
    if b is B.build_distractor:
        return b(df, task, ch, seed=seed)
    if b is B.build_cloze_options:
        return b(df, task, ch["all"], seed=seed)
    raise ValueError(task)


RECIPES: dict[str, Recipe] = {
    r.task: r
    for r in [
        Recipe("qqp", "pairs", "qqp", _ident, B.build_pair_compare),
        Recipe("winogrande", "choice", "winogrande", _ident, B.build_multiple_choice,
               options=dict(question="sentence", answers=["option1", "option2"], label="answer", offset=1, blank_fill=True)),
        Recipe("piqa", "choice", "piqa", _prep_piqa, B.build_multiple_choice,
               options=dict(question="goal", answers=["sol1", "sol2"], label="label", offset=0)),
        Recipe("mnli", "nli", "nli", _ident, B.build_class_template, pre_filter=B.drop_nogold,
               options=dict(columns=["text1", "text2"])),
        Recipe("snli", "nli", "nli", _ident, B.build_class_template, pre_filter=B.drop_nogold,
               options=dict(columns=["text1", "text2"])),
        Recipe("mintaka", "qa", "qa", _ident, B.build_shifted_answer),
        Recipe("yelp_polarity", "bin", "polarity", _ident, B.build_class_template, options=dict(columns=["text"])),
        Recipe("wikilingua", "qa", "summary", _ident, B.build_shifted_answer),
        Recipe("squad", "span", "squad", _prep_span, B.build_span),
        Recipe("offensive", "bin", "class", _ident, B.build_binary_class, options=dict(names="offensive")),
        Recipe("massive", "multi", "class", _ident, B.build_multi_class, options=dict(names="language")),
        Recipe("dpr", "sub", "dpr", _prep_sub, B.build_substitution),
        Recipe("qasc", "letter", "qasc", _prep_letter, B.build_lettered_choice),
        Recipe("sciq", "distract", "sciq", _ident, B.build_distractor),
        Recipe("race", "cloze", "race", _prep_cloze, B.build_cloze_options, pre_filter=B.cloze_filter),
        Recipe("samsum", "qa", "summary", _ident, B.build_shifted_answer),
    ]
}

TASKS = list(RECIPES)


def parse_exclude(exclude) -> list[str]:
    """Comma list (empty items allowed) -> task names."""
    if exclude is None:
        return []
    if isinstance(exclude, str):
        return [t for t in exclude.split(",") if t != ""]
    return [t for t in exclude if t]


KEYS = ["task", "sample_idx", "template_id", "is_true"]
_TASK, _SEED = "_task", "_seed"


def _sources(views: TaskViews, tasks) -> list[tuple[list[str], DataFrame]]:
    """(tasks, rows) of each view, filtered as the tasks' recipes say."""
    groups: dict[tuple, list[str]] = {}
    for t in tasks:
        groups.setdefault((RECIPES[t].view, RECIPES[t].pre_filter), []).append(t)
    out = []
    for (view, pre_filter), own in groups.items():
        rows = getattr(views, view)()
        out.append((own, pre_filter(rows) if pre_filter else rows))
    return out


def sample_tasks(views: TaskViews, tasks, n=DEFAULT_N, seed=42, write=True) -> dict[str, DataFrame]:
    """Builder input of every task, resized to ``n`` rows (B3): ``sample_idx``, ``source_id`` and the view's columns."""
    return {t: df for (_, t), df in sample_runs(views, tasks, n, [seed], write).items()}


def sample_runs(views: TaskViews, tasks, n, seeds, write=True) -> dict[tuple, DataFrame]:
    """``sample_tasks`` for several seeds at once, by (seed, task).

    The samples are drawn on ids alone: one job counts all tasks, one histogram cuts those that have more
    than ``n`` rows, one dense rank serves the bootstrap of the others.  The picked ids (seeds x tasks x n at most)
    are written, and each view is read once more, for all its tasks and seeds.  With ``write`` the rows are kept in
    a table per view, so later passes read ``n`` rows a task and seed whatever the size of the source.
    """
    tasks, seeds = list(tasks), list(seeds)
    if not tasks:
        raise ValueError("nothing to build: every task is excluded")
    sources = _sources(views, tasks)

    def units(some, more=lambda t: []):  # a row for every seed and task
        return F.array(*[F.struct(F.lit(s).cast("string").alias(_SEED), F.lit(t).alias(_TASK), *more(t)) for s in seeds for t in some])

    plain = union_all([rows.select(F.col("id").cast("bigint").alias("id"), F.array(*[F.lit(t) for t in own]).alias("own")) for own, rows in sources])
    plain = materialize_df(plain, "ids")  # views are joined and filtered once for all that follows
    counted = plain.select(F.explode("own").alias(_TASK)).groupBy(_TASK).count().collect()
    sizes = {r[_TASK]: r["count"] for r in counted}
    if empty := [t for t in tasks if not sizes.get(t)]:
        raise ValueError(f"{', '.join(empty)}: source table is empty")
    by_seed = F.array(*[F.lit(str(s)) for s in seeds])
    ids = plain.select("id", F.explode("own").alias(_TASK)).select("id", _TASK, F.explode(by_seed).alias(_SEED))
    by_unit = lambda *more: F.md5(F.concat_ws(":", F.col(_SEED), F.lit("samp"), F.col(_TASK), *more))
    picked, unit = [], [_SEED, _TASK]
    if many := [t for t in tasks if sizes[t] > n]:
        own = take_first(ids.filter(F.col(_TASK).isin(many)), by_unit(F.col("id").cast("string")), ["id"], n, unit)
        picked.append(own.select(*unit, "id", F.col("id").alias("sample_idx")))
    if few := [t for t in tasks if sizes[t] <= n]:
        order = by_unit(F.lit("rank"), F.col("id").cast("string"))
        ranked = dense_rank(ids.filter(F.col(_TASK).isin(few)), order, ["id"], unit, "_pos")
        size = units(few, lambda t: [F.lit(sizes[t]).cast("bigint").alias("size")])
        draws = ids.sparkSession.range(n).select(F.col("id").alias("sample_idx"), F.inline(size))
        at = F.pmod(hex_to_u32(by_unit(F.lit("boot"), F.col("sample_idx").cast("string"))), F.col("size"))
        picked.append(draws.withColumn("_pos", at).join(ranked, [*unit, "_pos"]).select(*unit, "id", "sample_idx"))
    picked = materialize_df(union_all(picked), "samples")
    out = {}
    for own, rows in sources:
        mine = picked.filter(F.col(_TASK).isin(own)).withColumn("source_id", F.col("id"))
        if len(own) * len(seeds) * n <= BROADCAST_ROWS:
            mine = F.broadcast(mine)
        rows = rows.join(mine, "id")
        if write:
            rows = materialize_df(rows, f"sampled-{own[0]}")
        for s in seeds:
            for t in own:
                out[s, t] = RECIPES[t].prep(rows.filter((F.col(_SEED) == str(s)) & (F.col(_TASK) == t)).drop(*unit))
    return out


def built(sample: dict[str, DataFrame], n, ppc, seed, texts=True) -> DataFrame:
    """The statements of all sampled tasks (C2-C14); without ``texts``, their other columns."""
    parts = []
    for t, df in sample.items():
        chosen = template_choice(seed, t, RECIPES[t].template_set, ppc)
        if not texts:
            chosen = {g: [(i, None) for i, _ in ts] for g, ts in chosen.items()}
        parts.append(_build(t, RECIPES[t], df, chosen, seed, n))
    return union_all(parts)


def statement_keys(sample: dict[str, DataFrame], n, ppc, seed) -> DataFrame:
    """Keys of all statements, written once; no text is read or made."""
    return materialize_df(built(sample, n, ppc, seed, texts=False).select(*KEYS), "statement-keys")


def chosen_statements(sample: dict[str, DataFrame], chosen: DataFrame, n, ppc, seed, value: str | None = None) -> DataFrame:
    """The statements whose keys ``chosen`` holds, each once, with the column ``value`` of ``chosen`` if it is named.

    The chosen templates of a sampled row go to the row, so only they are filled and no text is moved after it.
    """
    what = F.col(value) if value else F.lit(True)
    wanted = chosen.groupBy("task", "sample_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("template_id", what.alias("v")))).alias(B.WANTED)  # templates of a row
    )
    wanted = materialize_df(wanted, "wanted")
    rows = {t: df.join(wanted.filter(F.col("task") == t).drop("task"), "sample_idx", "left") for t, df in sample.items()}
    out = built(rows, n, ppc, seed)
    return out.withColumnRenamed(B.VALUE, value) if value else out.drop(B.VALUE)


def build_statements(views: TaskViews, tasks, n=DEFAULT_N, ppc=5, seed=42, materialize=False) -> DataFrame:
    """Resize (B3) and build (C*) every task, without a cap; ``materialize`` writes the statements."""
    out = built(sample_tasks(views, tasks, n, seed, write=False), n, ppc, seed)
    return materialize_df(out, "statements") if materialize else out


def task_statements(views: TaskViews, task: str, n=DEFAULT_N, ppc=5, seed=42) -> DataFrame:
    """Statements of one task, before the stratified cap."""
    return build_statements(views, [task], n, ppc, seed)


def cap_statements(statements: DataFrame, spc: int, seed=42) -> DataFrame:
    """Stratified cap of ``min(spc, len)`` statements per task, proportional to is_true (one pass, all tasks)."""
    return stratified_exact(statements, spc, seed, "strat", ["task", "sample_idx", "template_id"], "is_true", ["task"])


def task_corpus(views: TaskViews, task: str, n=DEFAULT_N, ppc=5, spc=4000, seed=42) -> DataFrame:
    """One task of the corpus."""
    return build_corpus(views, None, n, ppc, spc, seed, [task])


def _included(exclude, tasks) -> list[str]:
    excluded = set(parse_exclude(exclude))
    return [t for t in (tasks or TASKS) if t not in excluded]


def build_corpus(views: TaskViews, exclude=None, n=DEFAULT_N, ppc=5, spc=4000, seed=42, tasks=None) -> DataFrame:
    """C15 + A7: union of every non-excluded task corpus; excluded tasks are never read.

    Raises when nothing is left, as concatenating an empty list would.
    """
    sample = sample_tasks(views, _included(exclude, tasks), n, seed)
    return chosen_statements(sample, cap_statements(statement_keys(sample, n, ppc, seed), spc, seed), n, ppc, seed)


def corpus_keys(views: TaskViews, exclude=None, n=DEFAULT_N, ppc=5, spc=4000, seed=42, tasks=None) -> DataFrame:
    """``KEYS`` of ``build_corpus``, for profiles: no text is read or made."""
    sample = sample_tasks(views, _included(exclude, tasks), n, seed, write=False)
    return cap_statements(statement_keys(sample, n, ppc, seed), spc, seed)


def run_corpora(views: TaskViews, seeds, exclude=None, n=DEFAULT_N, ppc=5, spc=4000, tasks=None) -> dict:
    """The corpora of replicated runs (I7), each drawn, filled in and capped anew by its seed; the sources are read
    as often as for one.  Gives ``(keys, statements)`` of each seed."""
    sample = sample_runs(views, _included(exclude, tasks), n, seeds)
    out = {}
    for s in seeds:
        own = {t: df for (seed, t), df in sample.items() if seed == s}
        keys = cap_statements(statement_keys(own, n, ppc, s), spc, s)
        out[s] = keys, lambda own=own, keys=keys, s=s: chosen_statements(own, keys, n, ppc, s)
    return out


def corpus_profile(corpus: DataFrame) -> DataFrame:
    """Size and label balance per task."""
    return corpus.groupBy("task").agg(
        F.count(F.lit(1)).alias("n_statements"),
        F.sum("is_true").cast("bigint").alias("n_true"),
        F.round(F.avg("is_true"), 6).alias("share_true"),
    )
