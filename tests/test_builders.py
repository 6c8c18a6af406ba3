"""Statement builders and the corpus: invariants on hand-written frames and on the stand-in views."""

from pyspark.sql import functions as F

from claimforge.operators import builders as B
from claimforge.operators.corpus import RECIPES, TASKS, build_corpus, corpus_profile, parse_exclude, task_statements

T2 = [(0, "${1} / ${2}"), (1, "${2} ? ${1}")]


def _sampled(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("sample_idx", F.col("id")).withColumn("source_id", F.col("id"))


def test_pair_compare_labels(spark):
    df = _sampled(spark, [(1, "a", "b", 1), (2, "c", "d", 0)], "id long, text1 string, text2 string, label long")
    out = B.build_pair_compare(df, "t", T2, [(0, "not ${1} ${2}")], ["text1", "text2"]).collect()
    assert len(out) == 2 * 3
    for r in out:
        lab = 1 if r["source_id"] == 1 else 0
        assert r["is_true"] == (lab if r["template_id"] < 100 else 1 - lab)


def test_multiple_choice_truth_agrees_with_option(spark):
    rows = [(i, f"q_{i} _ end", f"a{i}", f"b{i}", str(1 + i % 2)) for i in range(200)]
    df = _sampled(spark, rows, "id long, sentence string, option1 string, option2 string, answer string")
    out = B.build_multiple_choice(df, "w", T2, "sentence", ["option1", "option2"], "answer", offset=1, blank_fill=True).collect()
    assert len(out) == 200 * 3
    for r in out:
        i = r["source_id"]
        right = f"a{i}" if i % 2 == 0 else f"b{i}"
        if r["template_id"] == B.BLANK_ID:
            assert "_" not in r["statement"].replace(f"q_{i}", "")
            assert (right in r["statement"]) == bool(r["is_true"])


def test_class_template_negative_uses_next_class(spark):
    tpls = [[(0, "c0 ${1}")], [(0, "c1 ${1}")], [(0, "c2 ${1}")]]
    df = _sampled(spark, [(i, f"x{i}", i % 3) for i in range(60)], "id long, text string, label long")
    for r in B.build_class_template(df, "n", tpls, ["text"]).collect():
        lab = r["source_id"] % 3
        cls = lab if r["is_true"] else (lab + 1) % 3
        assert r["statement"].startswith(f"c{cls} ")


def test_shifted_answer_never_equals_truth_and_block_of_one(spark):
    rows = [(i, f"q{i}", "same" if i < 5 else f"a{i}") for i in range(40)]
    df = _sampled(spark, rows, "id long, question string, answer string")
    out = B.build_shifted_answer(df, "m", [(0, "${1} -> ${2}")], "question", "answer", n_sample=40).collect()
    truth = dict((i, a) for i, _, a in rows)
    for r in out:
        ans = r["statement"].split(" -> ")[1]
        assert (ans == truth[r["source_id"]]) == bool(r["is_true"])
    # one row per block: the wrapped neighbour is the row itself, so every negative is dropped
    one = B.build_shifted_answer(df.limit(1), "m", [(0, "${1} -> ${2}")], "question", "answer", n_sample=1).collect()
    assert all(r["is_true"] == 1 for r in one)


def test_span_short_contexts(spark):
    rows = [(1, "x", "q", ["x"]), (2, "abc", "q", ["b"]), (3, "", "q", ["z"])]
    df = spark.createDataFrame(rows, "id long, context string, question string, t array<string>")
    df = df.select("id", "context", "question", F.struct(F.col("t").alias("text")).alias("answers")).withColumn(
        "sample_idx", F.col("id")).withColumn("source_id", F.col("id"))
    out = B.build_span(df, "s", [(0, "${3}")], "context", "question").collect()
    assert len(out) == 3
    for r in out:
        if not r["is_true"]:
            assert r["statement"] == ""  # spans of length 0 on contexts shorter than 4


def test_multi_class_negative_differs(spark):
    df = _sampled(spark, [(i, f"t{i}", i % 4) for i in range(300)], "id long, text string, label long")
    names = ["A", "B", "C", "D"]
    for r in B.build_multi_class(df, "m", [(0, "${2}")], "text", names).collect():
        assert (r["statement"] == names[r["source_id"] % 4]) == bool(r["is_true"])


def test_parse_exclude_allows_empty_items():
    assert parse_exclude("a,,b,") == ["a", "b"]
    assert parse_exclude(None) == []


def test_every_builder_runs_on_stand_ins(views):
    for task in TASKS:
        st = task_statements(views, task, n=300, ppc=2, seed=1)
        assert set(st.columns) == set(B.OUT_COLS)
        rows = st.select("is_true", "statement").collect()
        assert rows and all(r["statement"] is not None for r in rows), task
        assert {r["is_true"] for r in rows} <= {0, 1}


def test_corpus_caps_and_exclusion(views):
    corpus = build_corpus(views, "samsum,,wikilingua", n=300, ppc=2, spc=150, seed=3)
    prof = {r["task"]: r for r in corpus_profile(corpus).collect()}
    assert set(prof) == set(TASKS) - {"samsum", "wikilingua"}
    assert all(r["n_statements"] == 150 for r in prof.values())


def test_corpus_same_under_any_shuffle_partitioning(spark, views):
    def rows(parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        c = build_corpus(views, None, n=200, ppc=2, spc=120, seed=11, tasks=["qqp", "mintaka", "race", "massive"])
        return sorted((r["task"], r["sample_idx"], r["template_id"], r["statement"], r["is_true"]) for r in c.collect())

    try:
        a, b = rows(1), rows(16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b and len(a) == 4 * 120


def test_materialized_statements_cut_lineage_to_sources(views):
    from claimforge.operators.corpus import build_statements, cap_statements

    st = build_statements(views, ["qqp", "race"], n=150, ppc=2, seed=5, materialize=True)
    files = cap_statements(st, 100, 5).inputFiles()
    # the capped corpus reads only the written statements, never documents / part again
    assert files and all("/tables/statements-" in f or "/tables/cuts-" in f for f in files)


def test_suspect_negatives_share_a_character_with_an_answer(spark):
    from claimforge.functions.draws import py_draw

    context = "the cat sat on the mat and the cat ran"
    df = spark.createDataFrame([(i, i, context, "q", (["cat", "mat", ""],)) for i in range(300)], "sample_idx long, source_id long, context string, question string, answers struct<text: array<string>>")
    got = {r["sample_idx"]: r for r in B.build_span(df, "s", [(0, "${3}")], "context", "question", seed=5, flag=True).collect()}
    places = [(p, p + 3) for a in ("cat", "mat") for p in range(len(context)) if context.startswith(a, p)]
    seen = set()
    for i, r in got.items():
        n = py_draw(5, "spanlen:s", i) % (len(context) // 4 + 1)
        lo = py_draw(5, "spanstart:s", i) % max(len(context) - n, 1)
        want = r["is_true"] == 0 and any(lo < q and p < lo + n for p, q in places if n)
        assert r["is_suspect_negative"] == want and (r["is_true"] or r["statement"] == context[lo:lo + n])
        seen.add((r["is_true"], want))
    assert seen == {(0, True), (0, False), (1, False)}
