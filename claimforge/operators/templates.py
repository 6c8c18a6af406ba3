"""Template sets and template selection.

The sets are written from the slot contract of each task (the comments), which is all that a
builder relies on; how many templates a group has and how they read is free.  ``${n}`` is the n-th value passed to ``fill_template``.  A task's templates
are grouped: ``pos``/``neg`` for pair tasks, a class index for class-keyed
tasks, ``g1``..``g4`` for multi-group tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimforge.functions.draws import hash_key, py_hash_key

# ---- training tasks: each set is written from its slot contract alone -------------------------
TRAIN_TEMPLATES: dict[str, dict[str, list[str]]] = {
    # 1, 2: two questions
    "qqp": {
        "pos": [
            "One could swap ${1} for ${2}",
            "${1} // ${2} // both want one thing",
            "Whoever answers ${2} has answered ${1}",
            "Merge these: ${1} + ${2}",
        ],
        "neg": [
            "One could not swap ${1} for ${2}",
            "${1} // ${2} // each wants its own thing",
            "Keep these apart: ${1} + ${2}",
        ],
    },
    # 1: sentence with a blank, 2: what fills it
    "winogrande": {"all": ["[${2}] completes ${1}", "Gap text: ${1}\nGap: ${2}", "Read _ as ${2} in: ${1}"]},
    # 1: aim, 2: way
    "piqa": {"all": ["Aim - ${1}. Way - ${2}.", "${2}: that is how you ${1}", "Step for ${1}\n* ${2}", "Tip (${1}): ${2}", "If you want to ${1}, then ${2}"]},
    # 1: what is given, 2: what is claimed; one list per relation
    "nli": {
        "0": ["Granted ${1}, ${2} follows", "${2} [supported by: ${1}]"],
        "1": ["Granted ${1}, ${2} stays open", "${2} [not settled by: ${1}]"],
        "2": ["Granted ${1}, ${2} can't hold", "${2} [refuted by: ${1}]"],
    },
    # 1: question, 2: answer
    "qa": {"all": ["user> ${1}\nbot> ${2}", "${2} settles the question ${1}", "FAQ entry. ${1} :: ${2}"]},
    # 1: long text, 2: short text
    "summary": {"all": ["${2}\n(long form: ${1})", "tl;dr of ${1}: ${2}", "Headline: ${2}\nBody: ${1}", "${1}\n\nAbstract: ${2}"]},
    # 1: text; one list per tone
    "polarity": {
        "0": ["Thumbs down: ${1}", "${1} [unhappy customer]", "Complaint - ${1}", "One star. ${1}"],
        "1": ["Thumbs up: ${1}", "${1} [happy customer]", "Praise - ${1}", "Five stars. ${1}"],
    },
    # 1: passage, 2: question, 3: answer
    "squad": {"all": ["${2} ${3}, according to: ${1}", "Excerpt\n${1}\nQuiz\n${2}\nKey\n${3}"]},
    # 1: text, 2: class name
    "class": {"all": ["${2}: ${1}", "File under ${2} >> ${1}", "Tag(${1}) = ${2}"]},
    # 1: sentence, 2: pronoun, 3: whom it names
    "dpr": {"all": ["${2} = ${3} in: ${1}", "${1}\n(who is ${2}? ${3})"]},
    # g1: 1 lettered question, 2 letter; g2: 1 lettered question, 2 option; g3: 1 fact, 2 question, 3 option;
    # g4: 1 fact, 2 lettered question, 3 letter
    "qasc": {
        "g1": ["Tick ${2} on: ${1}", "${1}\nKey: ${2}"],
        "g2": ["${2} is the pick for ${1}", "${1}\nWritten out: ${2}"],
        "g3": ["Since ${1}, ${2} leads to ${3}", "${3} - asked ${2} - because ${1}"],
        "g4": ["Hint: ${1}\n${2}\nTick ${3}", "${2} (${3}, as ${1})"],
    },
    # g1: 1 question, 2 answer; g2: 1 support, 2 question, 3 answer
    "sciq": {
        "g1": ["Exam item ${1}, solution ${2}", "${2} <- ${1}", "Lab card: ${1} / ${2}"],
        "g2": ["Textbook says ${1}; hence for ${2} write ${3}", "${3} <- ${2} <- ${1}"],
    },
    # 1: article, 2: question with its option filled in
    "race": {"all": ["${2}\n-- from ${1}", "Having read ${1}: ${2}"]},
}

# ---- evaluation sets, from their slot contracts -------------------------------------------------
EVAL_TEMPLATES: dict[str, dict[str, list[str]]] = {
    # 1: premise, 2: choice
    "copa": {
        "cause": ["${2}; that is why ${1}", "First ${2}, then ${1}"],
        "effect": ["${1}; that is why ${2}", "First ${1}, then ${2}"],
    },
    # 1, 2: two sentences
    "mrpc": {"all": ["${1} can be retold as ${2}", "Twins: ${1} & ${2}", "${2} adds nothing to ${1}"]},
    # 1: title, 2: content
    "amazon_p": {
        "0": ["Would not buy again. ${1}: ${2}", "Refund wanted - ${1} - ${2}"],
        "1": ["Would buy again. ${1}: ${2}", "Well worth it - ${1} - ${2}"],
    },
    # 1: phrase, 2: ending
    "figqa": {"all": ["${1}, in plain words: ${2}", "Put simply, ${1} ${2}"]},
    # 1-4: story so far, 5: ending
    "storycloze": {"all": ["${1}. ${2}. ${3}. ${4}. At last ${5}", "(1) ${1} (2) ${2} (3) ${3} (4) ${4} (5) ${5}"]},
    # 1: title, 2: content, 3: topic
    "yahoo": {"all": ["Forum ${3}: ${1} ${2}", "${3} fans may like: ${1} - ${2}"]},
    # 1: text, 2: feeling
    "emotion": {"all": ["[${2}] ${1}", "${1} ... full of ${2}", "Mood ${2}: ${1}", "It takes ${2} to write ${1}"]},
}

# ---- class names of the stand-in label sets ------------------------------------------------------
CLASS_NAMES = {
    "offensive": ["harmless", "offensive"],
    "language": ["German", "English", "Spanish", "another language"],
    "topic": ["gardening", "astronomy", "cooking", "law", "football", "painting", "banking", "travel", "medicine", "programming"],
    "emotion": ["calm", "disgust", "pride", "boredom", "hope", "envy"],
}

# ---- prompt templates for the speed harness (D9, D10) --------------------------------------------
PROMPTS = {
    "copa": "Given {{ premise }}, is {{ choice1 }} likelier than {{ choice2 }}?",
    "mrpc": "{{ text1 }}\n---\n{{ text2 }}\nTwins (yes/no):",
    "figqa": "{{ sentence }}: {{ option1 }} or {{ option2 }}?",
    "amazon_p": "Customer wrote: {{ text }}\nHappy?",
    "storycloze": "{{[input_sentence_1, input_sentence_2]|join(' ')}}",
    "yahoo": "Pick a forum for this post: {{ text }}",
    "emotion": "Name the mood of: {{ text }}",
}


def choose_templates(seed, task: str, group: str, templates: list[str], k: int) -> list[tuple[int, str]]:
    """B5 on the driver: ``min(len, k)`` templates in md5 order, as (index, text)."""
    order = sorted(range(len(templates)), key=lambda i: (py_hash_key(seed, f"tpl:{task}:{group}", i), i))
    return [(i, templates[i]) for i in sorted(order[: min(k, len(templates))])]


def template_table(spark: SparkSession, sets: dict[str, dict[str, list[str]]]) -> DataFrame:
    rows = [
        (task, group, i, t) for task, groups in sets.items() for group, ts in groups.items() for i, t in enumerate(ts)
    ]
    return spark.createDataFrame(rows, "task string, grp string, template_id int, template string")


def template_subset(templates: DataFrame, ppc: int, seed) -> DataFrame:
    """B5 as a DataFrame operator: rank templates per (task, group) by md5, keep ``ppc``."""
    h = hash_key(seed, "tpl", F.col("task"), F.col("grp"), F.col("template_id"))
    w = Window.partitionBy("task", "grp").orderBy(h, "template_id")
    return templates.withColumn("tpl_rank", F.row_number().over(w)).filter(F.col("tpl_rank") <= ppc)


def eval_template_draw(spark: SparkSession, templates: DataFrame, runs: DataFrame, seed) -> DataFrame:
    """One template per (run, evaluation set, family), drawn from the run number."""
    sizes = templates.groupBy("task", "grp").agg(F.count(F.lit(1)).alias("n_t"))
    per_run = runs.crossJoin(F.broadcast(sizes)).withColumn(
        "template_id", F.pmod(F.conv(F.substring(hash_key(seed, "evt", "task", "grp", "run"), 1, 8), 16, 10).cast("bigint"), F.col("n_t")).cast("int")
    )
    return per_run.join(F.broadcast(templates), ["task", "grp", "template_id"]).select(
        "run", "task", "grp", "template_id", "template"
    )
