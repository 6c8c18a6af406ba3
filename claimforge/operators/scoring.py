"""Scoring and metrics.

Scorers add a ``p_true`` column to a statement table.  Two are provided:

* ``keyed_scorer`` - a deterministic stand-in model: ``p_true`` is the md5 of
  ``seed:statement`` read as a fraction.  JVM-only, reproducible in SQL, used by
  the oracle-checked queries.
* ``pandas_scorer`` - wraps any Python callable ``list[str] -> list[float]``
  (a fitted model loaded once per Python worker) into an iterator pandas UDF; Arrow
  batches move statements to the worker and scores back.

``fit_scorer`` (F2) trains a real text classifier with ``pyspark.ml``.
"""

from __future__ import annotations

import time
import uuid

from itertools import takewhile
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from claimforge.functions.draws import hex_to_u32


def keyed_p(seed, statement: Column, salt: str = "score") -> Column:
    return hex_to_u32(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), statement))) / F.lit(4294967296.0)


def keyed_scorer(df: DataFrame, seed=42, col: str = "statement") -> DataFrame:
    """F1 (deterministic stand-in model): ``p_true`` in [0, 1)."""
    return df.withColumn("p_true", keyed_p(seed, F.col(col)))


def keyed_logits(df: DataFrame, seed=42, col: str = "statement") -> DataFrame:
    """Two-class logits for one statement (input of F5)."""
    return df.withColumn("logits", F.array(keyed_p(seed, F.col(col), "l0"), keyed_p(seed, F.col(col), "l1")))


def pandas_scorer(fn: Callable[[list[str]], list[float]], batch_size: int = 64):
    """F1 (user model): returns ``df -> df + p_true`` running ``fn`` on Arrow batches.

    ``fn`` is called with lists of at most ``batch_size`` statements; heavy model objects
    should be created lazily inside ``fn`` (once per worker process).
    """

    @pandas_udf("double")
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            vals = s.tolist()
            out: list[float] = []
            for i in range(0, len(vals), batch_size):
                out.extend(float(x) for x in fn(vals[i : i + batch_size]))
            yield pd.Series(out, dtype="float64")

    def apply(df: DataFrame, col: str = "statement") -> DataFrame:
        return df.withColumn("p_true", _score(F.col(col)))

    return apply


# ---- arg-max ------------------------------------------------------------------------------------


def argmax_candidates(scored: DataFrame, keys=("dataset", "example_id")) -> DataFrame:
    """predicted candidate = highest ``p_true``; the first index wins ties.

    An example's few candidates are collected (a hash aggregate, no sort of the input) and compared
    as (probability, -index).
    """
    keys = list(keys)
    some = F.array_max(F.collect_list(F.struct(F.col("p_true"), (-F.col("cand_idx")).alias("i"))))
    return scored.groupBy(*keys).agg((-some["i"]).alias("pred"), F.min("label").alias("label"))


def argmax_logits(df: DataFrame, col: str = "logits") -> DataFrame:
    """class = position of the largest logit (first wins)."""
    return df.withColumn("pred", (F.array_position(F.col(col), F.array_max(F.col(col))) - 1).cast("int"))


# ---- metrics ---------------------------------------------------------------------------------------


def accuracy_by(pred: DataFrame, keys=("dataset",)) -> DataFrame:
    """share of predictions equal to the reference."""
    return pred.groupBy(*keys).agg(
        F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n_examples"),
    )


def binary_metrics(pred: DataFrame, keys=()) -> DataFrame:
    """accuracy, F1, precision, recall for positive class 1 (0 when undefined)."""
    p, y = F.col("pred"), F.col("label")
    tp = F.sum(((p == 1) & (y == 1)).cast("long"))
    fp = F.sum(((p == 1) & (y != 1)).cast("long"))
    fn = F.sum(((p != 1) & (y == 1)).cast("long"))
    agg = pred.groupBy(*keys).agg(
        F.avg((p == y).cast("double")).alias("accuracy"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")
    )
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0,
                2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(F.lit(0.0))
    return agg.select(*keys, "accuracy", f1.alias("f1"), prec.alias("precision"), rec.alias("recall"))


def softmax_pair(scored: DataFrame, keys=("dataset", "example_id")) -> DataFrame:
    """F8: softmax over the candidate scores of an example; cross-entropy against the label."""
    keys = list(keys)
    g = scored.groupBy(*keys).agg(
        F.max("p_true").alias("_m"),
        F.first("label").alias("label"),
        F.collect_list(F.struct("cand_idx", "p_true")).alias("_c"),
    )
    denom = F.aggregate(F.col("_c"), F.lit(0.0), lambda acc, c: acc + F.exp(c["p_true"] - F.col("_m")))
    p_label = F.exp(
        F.filter(F.col("_c"), lambda c: c["cand_idx"] == F.col("label"))[0]["p_true"] - F.col("_m")
    ) / denom
    return g.select(*keys, "label", p_label.alias("p_label"), (-F.log(p_label)).alias("loss"))


def throughput(log: DataFrame, keys=("dataset",), n_col="n_examples", t_col="seconds", cost: dict | None = None,
               default_cost: float = 1.0) -> DataFrame:
    """examples per second = total examples / total seconds.

    With ``cost`` (statements scored per example, by dataset; ``default_cost`` otherwise)
    a ``statements_per_s`` column is added.
    """
    out = log.groupBy(*keys).agg((F.sum(n_col) / F.sum(t_col)).alias("examples_per_s"))
    if cost is not None:
        m = F.create_map(*[x for k, v in cost.items() for x in (F.lit(k), F.lit(float(v)))])
        factor = F.coalesce(m[F.col("dataset")], F.lit(float(default_cost)))
        out = out.withColumn("statements_per_s", F.col("examples_per_s") * factor)
    return out


def random_baseline(counts: DataFrame, set_sizes: dict[str, int]) -> DataFrame:
    """accuracy of a random guess per set, ``1 / candidate answers``, which the set's definition says
    (no statement is built); ``counts`` is ``(dataset, n_examples)``."""
    sizes = F.create_map(*[F.lit(x) for kv in set_sizes.items() for x in kv])
    return counts.withColumn("accuracy", F.lit(1.0) / F.element_at(sizes, F.col("dataset"))).withColumn("model", F.lit("random"))


# ---- F2: fit a claim classifier with pyspark.ml ------------------------------------------------------


def fit_scorer(train: DataFrame, num_features: int = 1 << 18, max_iter: int = 20, reg: float = 0.01):
    """RegexTokenizer -> HashingTF -> IDF -> LogisticRegression on (statement, is_true)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    tok = RegexTokenizer(inputCol="statement", outputCol="_tokens", pattern="\\W+", minTokenLength=1)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=max_iter, regParam=reg)
    data = train.filter(F.col("is_true").isNotNull()).withColumn("_label", F.col("is_true").cast("double"))
    return Pipeline(stages=[tok, tf, idf, lr]).fit(data)


def model_scorer(model):
    """Scorer from a fitted pipeline: ``p_true`` = probability of class 1."""
    from pyspark.ml.functions import vector_to_array

    def apply(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        return out.withColumn("p_true", vector_to_array("probability")[1]).drop(
            "_tokens", "_tf", "_features", "rawPrediction", "probability", "prediction"
        )

    return apply


def _settings(stage) -> tuple[str, dict]:
    """What a stage without learned state does."""
    return type(stage).__name__, {p.name: v for p, v in stage.extractParamMap().items()}


def model_scorers(models: dict):
    """Scorer from several fitted pipelines, in one pass over the statements: for each a column of its key's name
    with its probability of class 1.

    The tokens and term frequencies that pipelines begin with have no learned state: models that make them alike
    share them, so a statement is split and hashed once.  What is learned (IDF weights, classifier) is each model's own.
    """
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    def apply(df: DataFrame) -> DataFrame:
        out, made, shared, columns = df, None, [], list(df.columns)
        for name, model in models.items():
            first = list(takewhile(lambda s: isinstance(s, (RegexTokenizer, HashingTF)), model.stages))
            if made != (wanted := [_settings(s) for s in first]):
                out, made, shared = out.drop(*shared), wanted, [s.getOutputCol() for s in first]
                for stage in first:
                    out = stage.transform(out)
            for stage in model.stages[len(first):]:
                out = stage.transform(out)
            columns.append(name)
            out = out.withColumn(name, vector_to_array("probability")[1]).select(*columns, *shared)
        return out.drop(*shared)

    return apply


def save_scorer(model, path: str) -> None:
    """Persist a fitted scorer (overwrite)."""
    model.write().overwrite().save(path)


def load_scorer(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


class ScorerStore:
    """Fitted scorers below a folder, by run number.

    Every save writes a new version and then its manifest, one small file that names it; a version without manifest
    (a save that was cut off) is never read.  The folder may be in any store that Spark writes to.
    """

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, model, run: int) -> str:
        """Store a scorer as the newest of its run; returns its folder."""
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        model.write().save(f"{self.root}/run={int(run)}/{version}/model")
        note = [(int(run), version, type(model).__name__)]
        manifest = f"{self.root}/run={int(run)}/{version}/manifest"
        self.spark.createDataFrame(note, "run int, version string, kind string").coalesce(1).write.json(manifest)
        return f"{self.root}/run={int(run)}/{version}"

    def versions(self, run: int) -> list[str]:
        """Complete versions of a run, oldest first."""
        folder, fs = self._files(f"run={int(run)}")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(n for n in names if fs.exists(self._files(f"run={int(run)}", n, "manifest", "_SUCCESS")[0]))

    def runs(self) -> list[int]:
        folder, fs = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        runs = sorted(int(n.removeprefix("run=")) for n in names if n.startswith("run="))
        return [r for r in runs if self.versions(r)]

    def load(self, run: int, version: str | None = None):
        """The newest complete scorer of a run, or a version of it."""
        found = self.versions(run)
        if not found or version not in (None, *found):
            raise FileNotFoundError(f"no complete scorer of run {run} below {self.root}")
        return load_scorer(f"{self.root}/run={int(run)}/{version or found[-1]}/model")
