"""Column helpers: draws, template filling, text utilities, formatting."""

import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from claimforge.functions import text as text_functions
from claimforge.functions import (
    draw,
    fill_template,
    format_1f,
    model_short_name,
    parse_percent,
    py_draw,
    render_prompt,
    replace_word,
    shuffle_words,
    word_count,
)


def test_draw_matches_python_md5(spark):
    df = spark.range(5)
    got = [r["d"] for r in df.select("id", draw(42, "x", "id").alias("d")).orderBy("id").collect()]
    want = [int(hashlib.md5(f"42:x:{i}".encode()).hexdigest()[:8], 16) for i in range(5)]
    assert got == want
    assert [py_draw(42, "x", i) for i in range(5)] == want


def test_fill_template_chains_and_keeps_unused_slots(spark):
    df = spark.createDataFrame([("a${2}", "b")], "v1 string, v2 string")
    out = df.select(fill_template("[${1}|${2}|${3}]", [F.col("v1"), F.col("v2")]).alias("s")).first()["s"]
    # ${2} inserted by the first value is replaced in the second step; ${3} has no value
    assert out == "[ab|b|${3}]"


def test_fill_template_null_value_gives_null(spark):
    df = spark.createDataFrame([(None,)], "v string")
    assert df.select(fill_template("x ${1}", [F.col("v")]).alias("s")).first()["s"] is None


def test_replace_word_quotes_pattern_and_replacement(spark):
    df = spark.createDataFrame(
        [("It is it, not bit. (a.b) and A.B", "it", "$1\\x"), ("see (a.b) here", "(a.b)", "Q")],
        "s string, p string, c string",
    )
    out = [r["o"] for r in df.select(replace_word("s", "p", "c").alias("o")).collect()]
    assert out[0] == "$1\\x is $1\\x, not bit. (a.b) and A.B"
    # regex characters are literal; "(" has no word boundary before it, as with re.sub(r"\b" + re.escape(p) + r"\b")
    assert out[1] == "see (a.b) here"


def _shuffled(text, prefix):
    h = hashlib.md5(prefix.encode()).hexdigest()
    a, b = int(h[:8], 16), int(h[8:16], 16)
    words = [w for w in re.split("[ \t\n\r\f]+", text) if w]
    key = lambda i: ((a + i * 2654435761) % 2147483647 * ((b + i * 40503) % 2147483629) % 2147483587, i)
    return " ".join(words[i] for i in sorted(range(len(words)), key=key))


def test_shuffle_runs_on_batches_with_the_same_order(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["", " ", None, "\u000b", " a", "a ", "\r\n"] + ["".join(rng.choice("ab \t\n\r\f\u000bä\u2003😀\x85") for _ in range(rng.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "id long, t string").repartition(3)
    got = df.select("id", "t", shuffle_words("t", 42, "s", F.col("id")).alias("o"))
    # no lambda function over the words, which the JVM interprets word by word
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        assert r["o"] == (None if r["t"] is None else _shuffled(r["t"], "42:s" if r["id"] is None else f"42:s:{r['id']}"))
    # slices of a batch are put together again
    monkeypatch.setattr(text_functions, "_SHUFFLE_BYTES", 100)
    array = text_functions._shuffle_array(pa.array(texts)[2:], pa.array([str(i) for i in range(len(texts))])[2:], "p")
    assert array.to_pylist() == [None if t is None else _shuffled(t, f"p:{i}") for i, t in enumerate(texts)][2:]
    assert text_functions._shuffle_array(pa.array([], pa.string()), pa.array([], pa.string()), "p").to_pylist() == []


def test_word_count_and_shuffle(spark):
    df = spark.createDataFrame([(1, "  one two\tthree\nfour  "), (2, ""), (3, None)], "id long, t string")
    rows = {r["id"]: r for r in df.select("id", word_count("t").alias("n"), shuffle_words("t", 42, "s", F.col("id")).alias("sh")).collect()}
    assert rows[1]["n"] == 4 and rows[2]["n"] == 0
    assert sorted(rows[1]["sh"].split(" ")) == ["four", "one", "three", "two"]
    assert rows[2]["sh"] == ""
    assert rows[3]["sh"] is None


def test_format_matches_python(spark):
    vals = [0.25, 2.35, 92.45, 1234.55, 0.0, 1e6 + 0.05]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["f"] for r in df.select(format_1f("x").alias("f")).collect()]
    assert got == ["{:,.1f}".format(v) for v in vals]


def test_parse_percent_and_short_name(spark):
    df = spark.createDataFrame([("73.5%", "org/model"), ("", "bare"), ("12%%", "a/b/c")], "p string, m string")
    rows = df.select(parse_percent("p").alias("x"), model_short_name("m").alias("s")).collect()
    assert abs(rows[0]["x"] - 0.735) < 1e-12 and rows[1]["x"] is None and abs(rows[2]["x"] - 0.12) < 1e-12
    assert [r["s"] for r in rows] == ["model", None, "b"]


def test_render_prompt_and_rejects_expressions(spark):
    df = spark.createDataFrame([("p", "c")], "premise string, choice1 string")
    assert df.select(render_prompt("{{ premise }} so {{choice1}}").alias("x")).first()["x"] == "p so c"
    import pytest

    with pytest.raises(ValueError):
        render_prompt("{{[a, b]|join(' ')}}")


def test_filled_word_count_is_that_of_the_filled_text(spark):
    import random

    from claimforge.functions.text import fill_template, filled_word_count, holds_placeholder

    rng = random.Random(4)
    pieces = ["a", "bc", " ", "", "\t", "x y", " z", "w ", "\n\nq", "$", "\u00a0", "."]
    rows = [tuple("".join(rng.choice(pieces) for _ in range(rng.randrange(4))) for _ in range(2)) for _ in range(150)] + [(None, "a")]
    df = spark.createDataFrame(rows, "u string, v string")
    for template in ["${1} is ${2}", "${1}${2}", "a${1}b${2}c", " ${2} ", "no slot", "${1}: ${3}?", "${1}${1} ${2}${9}"]:
        values = [F.col("u"), F.col("v"), "new topic"]
        filled = fill_template(template, [F.lit(v) if isinstance(v, str) else v for v in values])
        got = df.select("u", "v", filled_word_count(template, values).alias("got"), word_count(filled).alias("want")).collect()
        assert all(r["got"] == r["want"] or "${1}" not in template and r["want"] is None for r in got)
        mixed = [shuffle_words("u", 1, "s", F.col("v")), shuffle_words("v", 2, "s", F.col("u")), F.lit("new topic")]
        got = df.filter("v is not null and u is not null").select(
            filled_word_count(template, values, True).alias("got"), word_count(fill_template(template, mixed)).alias("want")).collect()
        assert all(r["got"] == r["want"] for r in got)
    odd = spark.createDataFrame([("a ${2}",), ("a {2}",), ("",)], "u string")
    assert [r[0] for r in odd.select(holds_placeholder(["u"])).collect()] == [True, False, False]


def test_short_examples_are_those_with_short_statements(spark):
    from claimforge.operators import evalsets as EV

    words = lambda n: " ".join(["w"] * n)
    rows = [(k, t, c, 0) for k, (t, c) in enumerate([("a", words(n)) for n in range(10, 30)] + [("${2} x", words(9)), ("${3}${3}", words(12)), (None, "b"), (" ", "")])]
    df = spark.createDataFrame(rows, "id long, title string, content string, label int")
    names = ["law", "fine  art", " odd "]
    for shuffle in (False, True):
        every = EV.eval_class_candidates(df, ["title", "content"], names, 1, 0, shuffle, "yahoo")
        most = every.groupBy("example_id").agg(F.max(word_count("statement")).alias("n"), F.count("statement").alias("built"))
        for limit in (18, 24, 32):
            want = sorted(r["example_id"] for r in most.filter((F.col("n") < limit) & (F.col("built") == 3)).collect())
            got = EV.short_examples(df, ["title", "content"], names, 1, 0, shuffle, "yahoo", limit)
            assert sorted(r["id"] for r in got.collect()) == want and got.columns == df.columns
            assert 0 < len(want) < len(rows) or limit == 32
