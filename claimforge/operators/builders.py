"""Statement builders (C2-C14): task rows -> (statement, is_true) rows.

Input: a sampled task frame with ``sample_idx`` (unique per sampled row, keys every
draw) and ``source_id``.  Output columns (all builders)::

    task, source_id, sample_idx, template_id, polarity, statement, is_true

Shape of every builder: per-row draws as columns -> one array of
``struct(template_id, statement)`` per row -> ``inline``.  Everything stays in
whole-stage-codegen expressions; there is no Python in the path.

A frame with a column ``WANTED`` (map of template id to any value) asks for some statements
only: other templates are not filled, and the value comes out as column ``VALUE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.functions.draws import draw, draw_mod
from claimforge.functions.text import fill_template, replace_word

OUT_COLS = ["task", "source_id", "sample_idx", "template_id", "polarity", "statement", "is_true"]
BLANK_ID = -1  # template id of rows built without a template (blank fill, pronoun substitution)
WANTED, VALUE = "_wanted", "_value"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _fill(template: str | None, values) -> Column:
    """``fill_template``; a template of None (only keys are wanted) makes no text."""
    return F.lit(None).cast("string") if template is None else fill_template(template, values)


def is_positive(seed, task: str) -> Column:
    """positive/negative with p = 1/2, one draw per sampled row."""
    return draw_mod(seed, f"pol:{task}", 2, "sample_idx") == 0


def _items(df: DataFrame, items: list[tuple]) -> Column:
    """Array of ``struct(template_id, statement, ...)``; null in place of those that are not wanted."""
    structs = []
    for tid, statement, *more in items:
        one = F.struct(F.lit(tid).alias("template_id"), statement.alias("statement"), *more)
        structs.append(F.when(F.map_contains_key(WANTED, F.lit(tid)), one) if WANTED in df.columns else one)
    return F.array(*structs)


def _explode(df: DataFrame, items: list[tuple[int, Column]]) -> DataFrame:
    return df.select("*", F.inline(_items(df, items)))


def _finish(df: DataFrame, task: str, positive: Column, is_true: Column, more=()) -> DataFrame:
    more = list(more)
    if WANTED in df.columns:
        df = df.filter(F.col("template_id").isNotNull())
        more += [F.element_at(F.col(WANTED), F.col("template_id")).alias(VALUE)]
    return df.select(
        F.lit(task).alias("task"),
        F.col("source_id").cast("bigint").alias("source_id"),
        F.col("sample_idx").cast("bigint").alias("sample_idx"),
        F.col("template_id").cast("int").alias("template_id"),
        F.when(positive, F.lit("positive")).otherwise(F.lit("negative")).alias("polarity"),
        "statement",
        is_true.cast("int").alias("is_true"),
        *more,
    )


def pick_wrong(seed, salt: str, n_options, truth: Column) -> Column:
    """Uniform index among ``n_options`` excluding ``truth``."""
    r = draw_mod(seed, salt, F.lit(n_options) - 1 if isinstance(n_options, int) else n_options - 1, "sample_idx")
    return r + F.when(r >= truth, 1).otherwise(0)


# ---------------------------------------------------------------------------------------------


def build_pair_compare(df, task, pos_templates, neg_templates, columns, label="label", seed=42):
    """Every row with every positive template (label kept) and negative template (1 - label)."""
    vals = [_c(c) for c in columns]
    items = [(i, _fill(t, vals), F.lit(True).alias("pos")) for i, t in pos_templates]
    items += [(100 + i, _fill(t, vals), F.lit(False).alias("pos")) for i, t in neg_templates]
    x = df.select("*", F.inline(_items(df, items)))
    lab = _c(label).cast("int")
    return _finish(x, task, F.col("pos"), F.when(F.col("pos"), lab).otherwise(1 - lab))


def build_multiple_choice(df, task, templates, question, answers, label, offset=0, blank_fill=False, seed=42):
    """C3 (+ C4): one drawn option per row; ``is_true = (int(label) - offset == option)``.

    With ``blank_fill`` an extra row replaces every ``_`` of the question by the option.
    """
    opt = draw_mod(seed, f"opt:{task}", len(answers), "sample_idx")
    x = df.withColumn("_opt", opt)
    ans = F.element_at(F.array(*[_c(a) for a in answers]), F.col("_opt").cast("int") + 1)
    x = x.withColumn("_ans", ans)
    items = [(i, _fill(t, [_c(question), F.col("_ans")])) for i, t in templates]
    if blank_fill:
        items.append((BLANK_ID, F.replace(_c(question), F.lit("_"), F.col("_ans"))))
    x = _explode(x, items)
    truth = (_c(label).cast("int") - F.lit(offset)) == F.col("_opt")
    return _finish(x, task, truth, truth)


def build_class_template(df, task, templates_by_class, text_columns, label="label", seed=42):
    """Positive uses the templates of class ``label``, negative those of ``(label + 1) mod k``.

    Rows with a negative label (no gold label, C6) must be removed before; see ``drop_nogold``.
    """
    k = len(templates_by_class)
    pos = is_positive(seed, task)
    lab = _c(label).cast("int")
    cls = F.when(pos, lab).otherwise(F.pmod(lab + 1, F.lit(k)))
    vals = [_c(c) for c in text_columns]
    choice = None
    for c in range(k):
        arr = _items(df, [(c * 100 + i, _fill(t, vals)) for i, t in templates_by_class[c]])
        choice = F.when(cls == c, arr) if choice is None else choice.when(cls == c, arr)
    x = df.withColumn("_pos", pos).select("*", F.inline(choice))
    return _finish(x, task, F.col("_pos"), F.col("_pos"))


def drop_nogold(df: DataFrame, label="label") -> DataFrame:
    """Rows without a gold label (negative label) are removed before sampling."""
    return df.filter(_c(label) >= 0)


def build_shifted_answer(df, task, templates, question, answer, n_sample, seed=42, block_size=1000):
    """The negative answer is the next distinct answer inside a random block (wrapping).

    Blocks are ``ceil(n / block_size)`` md5 buckets of the sampled rows, so the window is
    spread over many tasks.  A negative is dropped only if its whole block has one answer.
    """
    n_blocks = max(1, -(-int(n_sample) // block_size))
    pos = is_positive(seed, task)
    x = df.withColumn("_blk", draw_mod(seed, f"blk:{task}", n_blocks, "sample_idx")).withColumn("_pos", pos)
    w = Window.partitionBy("_blk").orderBy("sample_idx")
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # where the next row has another answer; the first such place from a row on ends its run of equal answers
    follow = F.lead(F.struct(_c(answer).alias("v"))).over(w)
    x = x.withColumn("_turn", F.when(follow.isNotNull() & ~follow["v"].eqNullSafe(_c(answer)), follow))
    ahead = F.first("_turn", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    head = F.first(F.struct(_c(answer).alias("v"))).over(wall)  # the block starts again
    head = F.when(~head["v"].eqNullSafe(_c(answer)), head)
    second = F.first("_turn", ignorenulls=True).over(wall)
    x = x.withColumn("_next", F.coalesce(ahead, head, second))
    x = x.filter(F.col("_pos") | F.col("_next").isNotNull()).withColumn("_other", F.col("_next")["v"])
    ans = F.when(F.col("_pos"), _c(answer)).otherwise(F.col("_other"))
    x = x.withColumn("_ans", ans)
    x = _explode(x, [(i, _fill(t, [_c(question), F.col("_ans")])) for i, t in templates])
    return _finish(x, task, F.col("_pos"), F.col("_pos"))


def build_span(df, task, templates, context, question, answers="answers", seed=42, flag=False):
    """negative = random character span of the context (length in [0, len/4]).

    The drawn span may hold the truth.  ``flag`` adds ``is_suspect_negative``: the span of a negative row shares a
    character with an occurrence of an answer text.  That is so if the text is found in the span lengthened by one
    character less than the text at both ends.
    """
    pos = is_positive(seed, task)
    ln = F.length(_c(context))
    span = draw_mod(seed, f"spanlen:{task}", F.floor(ln / 4).cast("bigint") + 1, "sample_idx")
    start = F.pmod(draw(seed, f"spanstart:{task}", "sample_idx"), F.greatest(ln - span, F.lit(1)))
    wrong = F.substring(_c(context), (start + 1).cast("int"), span.cast("int"))
    truth = F.get(F.col(answers)["text"], 0)

    def met(a):
        first = F.greatest(start - F.length(a) + 1, F.lit(0))
        near = F.substring(_c(context), (first + 1).cast("int"), (start + span + F.length(a) - 1 - first).cast("int"))
        return (F.length(a) > 0) & F.contains(near, a)

    x = df.withColumn("_pos", pos).withColumn("_ans", F.when(pos, truth).otherwise(wrong))
    if flag:
        suspect = ~F.col("_pos") & (span > 0) & F.exists(F.col(answers)["text"], met)
        x = x.withColumn("is_suspect_negative", F.coalesce(suspect, F.lit(False)))
    x = _explode(x, [(i, _fill(t, [_c(context), _c(question), F.col("_ans")])) for i, t in templates])
    return _finish(x, task, F.col("_pos"), F.col("_pos"), ["is_suspect_negative"] * flag)


def build_binary_class(df, task, templates, text, class_names, label="label", seed=42):
    """Negative uses the other of two class names."""
    pos = is_positive(seed, task)
    lab = _c(label).cast("int")
    names = F.array(*[F.lit(n) for n in class_names])
    name = F.element_at(names, F.when(pos, lab).otherwise(1 - lab) + 1)
    x = df.withColumn("_pos", pos).withColumn("_ans", name)
    x = _explode(x, [(i, _fill(t, [_c(text), F.col("_ans")])) for i, t in templates])
    return _finish(x, task, F.col("_pos"), F.col("_pos"))


def build_multi_class(df, task, templates, text, class_names, label="label", seed=42):
    """negative = uniform wrong class name."""
    pos = is_positive(seed, task)
    lab = _c(label).cast("int")
    wrong = pick_wrong(seed, f"wrong:{task}", len(class_names), lab)
    names = F.array(*[F.lit(n) for n in class_names])
    x = df.withColumn("_pos", pos).withColumn("_ans", F.element_at(names, F.when(pos, lab).otherwise(wrong).cast("int") + 1))
    x = _explode(x, [(i, _fill(t, [_c(text), F.col("_ans")])) for i, t in templates])
    return _finish(x, task, F.col("_pos"), F.col("_pos"))


def build_substitution(df, task, templates, sentence, pronoun, candidates, label="label", seed=42):
    """C11: templates + one row with the pronoun replaced as a whole word (quoted, case-insensitive)."""
    pos = is_positive(seed, task)
    lab = _c(label).cast("int")
    cand = F.element_at(_c(candidates), F.when(pos, lab).otherwise(1 - lab) + 1)
    x = df.withColumn("_pos", pos).withColumn("_ans", cand)
    items = [(i, _fill(t, [_c(sentence), _c(pronoun), F.col("_ans")])) for i, t in templates]
    items.append((BLANK_ID, replace_word(_c(sentence), _c(pronoun), F.col("_ans"))))
    x = _explode(x, items)
    return _finish(x, task, F.col("_pos"), F.col("_pos"))


def build_lettered_choice(df, task, groups, seed=42, n_letters=8):
    """Eight lettered options, four template groups over (question, letter, option text, fact)."""
    pos = is_positive(seed, task)
    key = F.ascii(F.col("answerKey")) - 65
    idx = F.when(pos, key).otherwise(pick_wrong(seed, f"letter:{task}", n_letters, key))
    x = df.withColumn("_pos", pos).withColumn("_idx", idx)
    letter = F.chr((F.col("_idx") + 65).cast("int"))
    text = F.get(F.col("choices")["text"], F.col("_idx").cast("int"))
    fq, q, fact = F.col("formatted_question"), F.col("question"), F.col("combinedfact")
    slot_values = {"g1": [fq, letter], "g2": [fq, text], "g3": [fact, q, text], "g4": [fact, fq, letter]}
    items = []
    for gi, g in enumerate(["g1", "g2", "g3", "g4"]):
        items += [(gi * 100 + i, _fill(t, slot_values[g])) for i, t in groups.get(g, [])]
    x = _explode(x, items)
    return _finish(x, task, F.col("_pos"), F.col("_pos"))


def build_distractor(df, task, groups, seed=42):
    """Correct answer vs one of three distractor columns; groups without / with support."""
    pos = is_positive(seed, task)
    pick = draw_mod(seed, f"distract:{task}", 3, "sample_idx")
    dis = F.element_at(F.array("distractor1", "distractor2", "distractor3"), pick.cast("int") + 1)
    x = df.withColumn("_pos", pos).withColumn("_ans", F.when(pos, F.col("correct_answer")).otherwise(dis))
    items = [(i, _fill(t, [F.col("question"), F.col("_ans")])) for i, t in groups.get("g1", [])]
    items += [
        (100 + i, _fill(t, [F.col("support"), F.col("question"), F.col("_ans")])) for i, t in groups.get("g2", [])
    ]
    x = _explode(x, items)
    return _finish(x, task, F.col("_pos"), F.col("_pos"))


def cloze_filter(df: DataFrame, question="question") -> DataFrame:
    """C14 pre-filter: only questions containing ``" _"`` (runs before sampling)."""
    return df.filter(F.instr(_c(question), " _") > 0)


def build_cloze_options(df, task, templates, seed=42, n_options=4):
    """C14: replace ``_`` by the lettered option (A-D); template over (article, filled question)."""
    pos = is_positive(seed, task)
    key = F.ascii(F.col("answer")) - 65
    idx = F.when(pos, key).otherwise(pick_wrong(seed, f"cloze:{task}", n_options, key))
    opt = F.get(F.col("options"), idx.cast("int"))
    x = df.withColumn("_pos", pos).withColumn("_q", F.replace(F.col("question"), F.lit("_"), opt))
    x = _explode(x, [(i, _fill(t, [F.col("article"), F.col("_q")])) for i, t in templates])
    return _finish(x, task, F.col("_pos"), F.col("_pos"))
