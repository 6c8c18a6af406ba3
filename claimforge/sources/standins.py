"""Stand-in task tables over the driver tables (FIXTURES.md part 2).

Each view has the column shape of one family of labelled task tables; the SQL
twin of every view lives in ``claimforge.plans.sqlviews`` and both return the
same rows.  All views are lazy DataFrames: joins and filters are planned by
Catalyst together with whatever consumes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.sources.tables import source


def first_sentence(col: str):
    """Text up to the first full stop."""
    return F.split_part(F.col(col), F.lit("."), F.lit(1))


def after_first_sentence(col: str):
    """The rest of the text after its first full stop (empty if there is none)."""
    return F.expr(f"substring({col}, length(split_part({col}, '.', 1)) + 2)")


def after_sentence(col: str, n: int):
    """The rest of the text after its n-th full stop (empty if there are fewer)."""
    parts = f"split({col}, '[.]')"
    return F.expr(f"array_join(slice({parts}, {n + 1}, greatest(size({parts}) - {n}, 0)), '.')")


class TaskViews:
    """Lazily built views; a driver table is opened once per instance."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = source(self.spark, self.root, name)
        return self._tables[name]

    # -- documents-based views -------------------------------------------------
    def docs(self) -> DataFrame:
        d = self.table("documents")
        return d.select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")

    def bin(self) -> DataFrame:
        d = self.docs()
        lab = self.table("labels").select("doc_id", "toxic", "quality")
        return d.join(lab, d["id"] == lab["doc_id"]).select(
            d["id"], d["text"], lab["toxic"].alias("label"), lab["quality"]
        )

    def multi(self) -> DataFrame:
        lang = F.col("lang")
        label = (
            F.when(lang == "de", 0).when(lang == "en", 1).when(lang == "es", 2).otherwise(3)
        )
        return self.docs().select("id", "text", label.alias("label"))

    def pairs(self) -> DataFrame:
        a = self.docs().select("id", "text", "lang").alias("a")
        b = self.docs().select("id", "text", "lang").alias("b")
        return a.join(b, F.col("b.id") == F.col("a.id") + 1).select(
            F.col("a.id").alias("id"),
            F.col("a.text").alias("text1"),
            F.col("b.text").alias("text2"),
            F.when(F.col("a.lang") == F.col("b.lang"), 1).otherwise(0).alias("label"),
        )

    def nli(self) -> DataFrame:
        p = self.pairs()
        return p.select(
            "id", "text1", "text2",
            F.when(F.col("id") % 20 == 0, F.lit(-1)).otherwise(F.col("id") % 3).alias("label"),
        )

    def qa(self) -> DataFrame:
        c = self.table("conversations")
        u = c.filter(F.col("role") == "user").alias("u")
        a = c.filter(F.col("role") == "assistant").alias("a")
        return u.join(
            a, (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1)
        ).select(
            (F.col("u.conv_id") * (1 << 32) + F.col("u.turn")).alias("id"),
            F.col("u.text").alias("question"),
            F.col("a.text").alias("answer"),
        )

    def span(self) -> DataFrame:
        d = self.table("documents").filter(F.col("text").isNotNull())
        return d.select(
            F.col("doc_id").alias("id"),
            F.col("text").alias("context"),
            first_sentence("text").alias("question"),
            F.split_part(F.col("text"), F.lit(" "), F.lit(2)).alias("answer_text"),
        )

    def topic(self) -> DataFrame:
        """Documents with a title, the rest as content, and one of ten labels."""
        return self.docs().select(
            "id", first_sentence("text").alias("title"), after_first_sentence("text").alias("content"), (F.col("id") % 10).alias("label")
        )

    def emotion(self) -> DataFrame:
        """Documents with one of six labels."""
        return self.docs().select("id", "text", (F.col("id") % 6).alias("label"))

    # -- part-based views -------------------------------------------------------
    def _part(self) -> DataFrame:
        return self.table("part").select("p_partkey", "p_name", "p_brand", "p_type")

    def choice(self) -> DataFrame:
        k = F.col("p_partkey")
        return self._part().select(
            k.alias("id"),
            F.concat(F.lit("the _ item is "), F.col("p_name")).alias("sentence"),
            F.col("p_brand").alias("option1"),
            F.col("p_type").alias("option2"),
            (F.lit(1) + k % 2).cast("string").alias("answer"),
            (k % 2).alias("label"),
        )

    def sub(self) -> DataFrame:
        k = F.col("p_partkey")
        return self._part().select(
            k.alias("id"),
            F.concat(F.col("p_name"), F.lit(" met "), F.col("p_brand"), F.lit(" when It won; it left the pit")).alias(
                "sentence"
            ),
            F.lit("it").alias("pronoun"),
            F.col("p_name").alias("cand0"),
            F.col("p_brand").alias("cand1"),
            (k % 2).alias("label"),
        )

    def letter(self) -> DataFrame:
        k = F.col("p_partkey")
        return self._part().select(
            k.alias("id"),
            F.concat(F.lit("pick "), F.col("p_name")).alias("question"),
            F.concat(F.lit("pick "), F.col("p_name"), F.lit(" (A) .. (H)")).alias("formatted_question"),
            F.col("p_type").alias("combinedfact"),
            F.col("p_brand").alias("choice_stem"),
            F.chr((F.lit(65) + k % 8).cast("int")).alias("answerKey"),
        )

    def distract(self) -> DataFrame:
        k = F.col("p_partkey")
        return self._part().select(
            k.alias("id"),
            F.concat(F.lit("type of "), F.col("p_name")).alias("question"),
            F.col("p_type").alias("correct_answer"),
            F.col("p_brand").alias("distractor1"),
            F.col("p_name").alias("distractor2"),
            F.lit("none").alias("distractor3"),
            F.concat(F.col("p_name"), F.lit(" is made as "), F.col("p_type")).alias("support"),
        )

    def cloze(self) -> DataFrame:
        k = F.col("p_partkey")
        return self._part().select(
            k.alias("id"),
            F.col("p_name").alias("article"),
            F.when(k % 2 == 0, F.concat(F.lit("the _ "), F.col("p_name"))).otherwise(F.col("p_name")).alias("question"),
            F.col("p_brand").alias("opt_a"),
            F.col("p_type").alias("opt_b"),
            F.lit("plain").alias("opt_c"),
            F.lit("none").alias("opt_d"),
            F.chr((F.lit(65) + k % 4).cast("int")).alias("answer"),
        )

    # -- evaluation views ---------------------------------------------------------
    def copa(self) -> DataFrame:
        p = self.pairs()
        return p.select(
            "id",
            F.col("text1").alias("premise"),
            first_sentence("text2").alias("choice1"),
            after_first_sentence("text2").alias("choice2"),
            F.when(F.col("id") % 2 == 0, F.lit("cause")).otherwise(F.lit("effect")).alias("question"),
            (F.col("id") % 2).alias("label"),
        )

    def story(self) -> DataFrame:
        p = self.pairs()
        return p.select(
            "id",
            *[F.split_part(F.col("text1"), F.lit("."), F.lit(k)).alias(f"input_sentence_{k}") for k in range(1, 5)],
            after_sentence("text1", 4).alias("sentence_quiz1"),
            after_sentence("text2", 4).alias("sentence_quiz2"),
            (F.lit(1) + F.col("id") % 2).alias("answer_right_ending"),
        )

    # -- run records ------------------------------------------------------------------
    def runs(self) -> DataFrame:
        e = self.table("events")
        eid, uid = F.col("event_id"), F.col("user_id")
        shot = (
            F.when(eid % 6 == 0, "0").when(eid % 6 == 1, "32").when(eid % 6 == 2, "200")
            .when(eid % 6 == 3, "500").when(eid % 6 == 4, "1000").otherwise("full")
        )
        spc_values = [1000, 2000, 3000, 4000, 5000, 10000, 20000, 40000]
        spc = F.lit(50000)
        for i in reversed(range(len(spc_values))):
            spc = F.when(uid % 9 == i, F.lit(spc_values[i])).otherwise(spc)
        acc = (F.round(F.col("value") * 100).cast("bigint") % 1000).cast("double") / 1000
        return e.select(
            eid.alias("run_id"),
            (eid % 5).alias("model_no"),
            F.col("event_type").alias("dataset"),
            F.when(uid % 2 == 0, F.lit("org/base")).otherwise(F.lit("large")).alias("model"),
            shot.alias("shot"),
            spc.alias("SPC"),
            F.lit(5).alias("PPC"),
            F.when(uid % 7 == 0, F.lit("a,b")).alias("excluded"),
            acc.alias("accuracy"),
            (F.lit(10) + eid % 90).alias("n_examples"),
            (F.lit(1) + uid % 4).cast("double").alias("seconds"),
        )

    def wide_baseline(self) -> DataFrame:
        r = self.runs()

        def pct(shot):
            return F.concat(
                F.max(F.when(F.col("shot") == shot, F.col("run_id") % 100)).cast("string"), F.lit("%")
            )

        return r.groupBy("dataset").agg(
            F.lit("base").alias("model"),
            pct("full").alias("full_shot"),
            pct("1000").alias("shot_1000"),
            pct("0").alias("shot_0"),
        ).select(F.col("dataset").alias("eval_set"), "model", "full_shot", "shot_1000", "shot_0")

    def speed_wide(self) -> DataFrame:
        r = self.runs()

        def sp(ds):
            return F.avg(F.when(F.col("dataset") == ds, F.col("n_examples") / F.col("seconds")))

        return r.groupBy("model").agg(sp("click").alias("click"), sp("view").alias("view"), sp("error").alias("error"))
