"""Evaluation-set builders (D1-D8, D11): one statement per candidate answer, long form.

Output of every builder::

    dataset, example_id, cand_idx, statement, label

``label`` is the index of the right candidate (or the 0/1 label for single-statement
sets such as the paraphrase pair).  One template per evaluation set, family and run
is drawn on the driver (a plan-time constant, D11); ``shuffle`` applies the seeded
word shuffle (D8) to every slot value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions.draws import py_draw
from claimforge.functions.text import fill_template, filled_word_count, holds_placeholder, shuffle_words, token_count
from claimforge.operators.templates import CLASS_NAMES, EVAL_TEMPLATES
from claimforge.sources.standins import after_first_sentence, first_sentence

#: Statements of the topic and emotion sets are shorter than this.
MAX_EVAL_TOKENS = 514
#: Candidate answers of each set (a pair set has one statement and two classes).
SET_SIZES = {"copa": 2, "mrpc": 2, "amazon_p": 2, "figqa": 2, "storycloze": 2, "yahoo": 10, "emotion": 6}

OUT_COLS = ["dataset", "example_id", "cand_idx", "statement", "label"]


def pick_eval_template(seed, dataset: str, family: str, run: int = 0) -> tuple[int, str]:
    ts = EVAL_TEMPLATES[dataset][family]
    i = py_draw(seed, "evt", dataset, family, run) % len(ts)
    return i, ts[i]


def _slot(c, shuffle: bool, seed, dataset: str, slot: int, cand) -> Column:
    col = c if isinstance(c, Column) else F.col(c)
    if not shuffle:
        return col
    return shuffle_words(col, seed, f"shuf:{dataset}:{slot}", F.concat_ws(":", F.col("example_id").cast("string"), F.lit(str(cand))))


def _long(df: DataFrame, dataset: str, cands: list[Column], label: Column) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(i).alias("cand_idx"), s.alias("statement")) for i, s in enumerate(cands)])
    return df.select(F.lit(dataset).alias("dataset"), "example_id", label.cast("int").alias("label"), F.inline(arr)).select(*OUT_COLS)


def eval_cause_effect(df, seed=42, run=0, shuffle=False, dataset="copa"):
    """Template family chosen by the row's question (cause / other)."""
    _, t_cause = pick_eval_template(seed, dataset, "cause", run)
    _, t_effect = pick_eval_template(seed, dataset, "effect", run)
    x = df.withColumnRenamed("id", "example_id")
    cands = []
    for k, choice in enumerate(["choice1", "choice2"]):
        vals = [_slot("premise", shuffle, seed, dataset, 1, k), _slot(choice, shuffle, seed, dataset, 2, k)]
        cands.append(F.when(F.col("question") == "cause", fill_template(t_cause, vals)).otherwise(fill_template(t_effect, vals)))
    return _long(x, dataset, cands, F.col("label"))


def eval_pair(df, seed=42, run=0, shuffle=False, dataset="mrpc"):
    """One statement per pair; the label is kept."""
    _, t = pick_eval_template(seed, dataset, "all", run)
    x = df.withColumnRenamed("id", "example_id")
    vals = [_slot("text1", shuffle, seed, dataset, 1, 0), _slot("text2", shuffle, seed, dataset, 2, 0)]
    return _long(x, dataset, [fill_template(t, vals)], F.col("label"))


def eval_polarity_pair(df, seed=42, run=0, shuffle=False, dataset="amazon_p"):
    """D3: one text, a negative-class and a positive-class statement."""
    _, t_neg = pick_eval_template(seed, dataset, "0", run)
    _, t_pos = pick_eval_template(seed, dataset, "1", run)
    x = df.withColumnRenamed("id", "example_id")
    cands = []
    for k, t in enumerate([t_neg, t_pos]):
        vals = [_slot("title", shuffle, seed, dataset, 1, k), _slot("content", shuffle, seed, dataset, 2, k)]
        cands.append(fill_template(t, vals))
    return _long(x, dataset, cands, F.col("label"))


def eval_two_endings(df, seed=42, run=0, shuffle=False, dataset="figqa", label="labels"):
    """One template, two endings.  The label column (``labels``) is renamed first."""
    _, t = pick_eval_template(seed, dataset, "all", run)
    x = df.withColumnRenamed("id", "example_id").withColumnRenamed(label, "label")
    cands = [
        fill_template(t, [_slot("startphrase", shuffle, seed, dataset, 1, k), _slot(e, shuffle, seed, dataset, 2, k)])
        for k, e in enumerate(["ending1", "ending2"])
    ]
    return _long(x, dataset, cands, F.col("label"))


def eval_story_ending(df, seed=42, run=0, shuffle=False, dataset="storycloze"):
    """Four context sentences + ending; label = right ending - 1."""
    _, t = pick_eval_template(seed, dataset, "all", run)
    x = df.withColumnRenamed("id", "example_id")
    ctx = [f"input_sentence_{i}" for i in range(1, 5)]
    cands = []
    for k, e in enumerate(["sentence_quiz1", "sentence_quiz2"]):
        vals = [_slot(c, shuffle, seed, dataset, i + 1, k) for i, c in enumerate(ctx)] + [_slot(e, shuffle, seed, dataset, 5, k)]
        cands.append(fill_template(t, vals))
    return _long(x, dataset, cands, F.col("answer_right_ending") - 1)


def eval_class_candidates(df, text_cols, class_names, seed=42, run=0, shuffle=False, dataset="yahoo", limit=None):
    """One statement per class name; label = gold class index.  With ``limit``, of ``short_examples``."""
    _, t = pick_eval_template(seed, dataset, "all", run)
    if limit is not None:
        df = short_examples(df, text_cols, class_names, seed, run, shuffle, dataset, limit)
    x = df.withColumnRenamed("id", "example_id")
    cands = []
    for k, name in enumerate(class_names):
        vals = [_slot(c, shuffle, seed, dataset, i + 1, k) for i, c in enumerate(text_cols)] + [F.lit(name)]
        cands.append(fill_template(t, vals))
    return _long(x, dataset, cands, F.col("label"))


def short_examples(df, text_cols, class_names, seed=42, run=0, shuffle=False, dataset="yahoo", limit: int = MAX_EVAL_TOKENS):
    """Examples all of whose candidate statements have fewer than ``limit`` tokens.

    A predicate on the input row: no statement is made.  Candidates differ by the class name alone, so of names
    that begin and end with a word the longest decides.
    """
    _, t = pick_eval_template(seed, dataset, "all", run)
    plain = [name for name in class_names if name.strip() == name != ""]
    tested = [name for name in class_names if name not in plain] + sorted(plain, key=lambda name: len(name.split()))[-1:]
    short = [filled_word_count(t, [*(F.col(c) for c in text_cols), name], shuffle) < limit for name in tested]

    def built(k: int, name: str) -> Column:  # for the rare texts with a placeholder in them
        return fill_template(t, [*(_slot(c, shuffle, seed, dataset, i + 1, k) for i, c in enumerate(text_cols)), F.lit(name)])

    each = [token_count(built(k, name)) < limit for k, name in enumerate(class_names)]
    every = lambda tests: reduce(lambda a, b: a & b, tests)
    if shuffle:
        df = df.withColumn("example_id", F.col("id"))  # keys the shuffle
    out = df.filter(F.when(holds_placeholder(text_cols), every(each)).otherwise(every(short)))
    return out.drop("example_id") if shuffle else out


#: Text columns and class names of the sets with a length limit.
LIMITED = {"yahoo": (["title", "content"], "topic"), "emotion": (["text"], "emotion")}


def eval_topic_candidates(df, seed=42, run=0, shuffle=False):
    """Ten topics; over-long examples are left out."""
    columns, names = LIMITED["yahoo"]
    return eval_class_candidates(df, columns, CLASS_NAMES[names], seed, run, shuffle, "yahoo", MAX_EVAL_TOKENS)


def eval_emotion_candidates(df, seed=42, run=0, shuffle=False):
    """Six emotions; over-long examples are left out."""
    columns, names = LIMITED["emotion"]
    return eval_class_candidates(df, columns, CLASS_NAMES[names], seed, run, shuffle, "emotion", MAX_EVAL_TOKENS)


def wide_candidates(long: DataFrame, n_cands: int) -> DataFrame:
    """Long -> wide (``statement0..K-1``) for consumers that want one row per example."""
    cols = [F.max(F.when(F.col("cand_idx") == k, F.col("statement"))).alias(f"statement{k}") for k in range(n_cands)]
    return long.groupBy("dataset", "example_id", "label").agg(*cols)


# ---- views shaped as the evaluation tasks ------------------------------------------------------


def eval_inputs(views) -> dict[str, DataFrame]:
    """The seven evaluation sets over the stand-in views (column names as the modelled tasks)."""
    bin_ = views.bin()
    return {
        "copa": views.copa(),
        "mrpc": views.pairs(),
        "amazon_p": bin_.select(
            "id", first_sentence("text").alias("title"), after_first_sentence("text").alias("content"), "label"
        ),
        "figqa": views.choice().select(
            "id", F.col("sentence").alias("startphrase"), F.col("option1").alias("ending1"),
            F.col("option2").alias("ending2"), F.col("label").alias("labels"),
        ),
        "storycloze": views.story(),
        "yahoo": views.topic(),
        "emotion": views.emotion(),
    }


def build_eval_sets(views, seed=42, run=0, shuffle=False, datasets=None) -> dict[str, DataFrame]:
    inp = eval_inputs(views)
    fns = {
        "copa": lambda d: eval_cause_effect(d, seed, run, shuffle),
        "mrpc": lambda d: eval_pair(d, seed, run, shuffle),
        "amazon_p": lambda d: eval_polarity_pair(d, seed, run, shuffle),
        "figqa": lambda d: eval_two_endings(d, seed, run, shuffle),
        "storycloze": lambda d: eval_story_ending(d, seed, run, shuffle),
        "yahoo": lambda d: eval_topic_candidates(d, seed, run, shuffle),
        "emotion": lambda d: eval_emotion_candidates(d, seed, run, shuffle),
    }
    return {k: fns[k](inp[k]) for k in (datasets or fns)}


def example_counts(views, seed=42, run=0, datasets=None) -> DataFrame:
    """``dataset, n_examples``: how many examples each set has; no statement is made."""
    parts = []
    for name, rows in eval_inputs(views).items():
        if datasets is not None and name not in datasets:
            continue
        if name in LIMITED:
            columns, names = LIMITED[name]
            rows = short_examples(rows, columns, CLASS_NAMES[names], seed, run, False, name)
        parts.append(rows.agg(F.count(F.lit(1)).alias("n_examples")).select(F.lit(name).alias("dataset"), "n_examples"))
    return reduce(lambda a, b: a.unionByName(b), parts)
