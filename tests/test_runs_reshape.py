"""Run aggregation, reshaping, smoothing and scoring on hand-written frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimforge.operators import reshape as R
from claimforge.operators import runs as G
from claimforge.operators import scoring as SCR


def test_pooled_std_null_rules(spark):
    df = spark.createDataFrame([("a", 0.3), ("a", 0.4), ("b", 0.5), ("b", None), ("c", None)], "k string, std double")
    got = {r["k"]: r["p"] for r in df.groupBy("k").agg(G.pooled_std("std").alias("p")).collect()}
    assert abs(got["a"] - np.sqrt((0.09 + 0.16) / 2)) < 1e-12
    assert got["b"] is None and got["c"] is None


def test_run_summary_single_run_has_null_std(spark):
    rows = [(0, "m", "0", 1000, 5, None, "d", 0.5, 10, 2.0)]
    df = spark.createDataFrame(rows, "model_no int, model string, shot string, SPC int, PPC int, excluded string, dataset string, accuracy double, n_examples int, seconds double")
    r = G.run_summary(df).first()
    assert r["std"] is None and r["Mean"] == 0.5 and r["speed"] == 5.0


def test_exact_mean_is_partition_independent(spark):
    vals = [0.1 * (i % 7) + 1e-3 * i for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    a = df.repartition(1).agg(G.exact_mean("x").alias("m")).first()["m"]
    b = df.repartition(37).agg(G.exact_mean("x").alias("m")).first()["m"]
    assert a == b


def test_dedup_none_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4), ("b", 5)], "k string, v int")
    assert [r["v"] for r in R.dedup_none(df, ["k"]).collect()] == [3]


def test_dedup_first_explicit_order(spark):
    df = spark.createDataFrame([("a", 2, 20), ("a", 1, 10), ("b", 5, 50)], "k string, o int, v int")
    assert sorted(r["v"] for r in R.dedup_first(df, ["k"], ["o"]).collect()) == [10, 50]


def _np_savgol(y, window, order):
    y = np.asarray(y, dtype=float)
    n, half = len(y), window // 2
    out = np.empty(n)
    x = np.arange(window)
    for i in range(n):
        base = min(max(i - half, 0), n - window)
        coef = np.polyfit(x, y[base:base + window], order)
        out[i] = np.polyval(coef, i - base)
    return out


@pytest.mark.parametrize("n", [7, 9, 12])
def test_savgol_matches_polynomial_fit(spark, n):
    rng = np.random.default_rng(n)
    y = rng.normal(size=n).tolist()
    df = spark.createDataFrame([("s", i * 1000, v) for i, v in enumerate(y)], "k string, spc int, y double")
    for order in (3, 5):
        got = [r["y_s"] for r in R.savgol(df, ["k"], "spc", "y", 7, order, "y_s").orderBy("spc").collect()]
        assert np.allclose(got, _np_savgol(y, 7, order), atol=1e-9)


def test_smoothing_weights_are_exact():
    below, rows = R.hat_matrix(7, 3)
    assert (below, rows[3]) == (42, (-4, 6, 12, 14, 12, 6, -4)) and rows[0] == (39, 8, -4, -4, 1, 4, -2)
    for window, order in ((5, 2), (7, 5), (9, 4), (11, 3)):
        below, rows = R.hat_matrix(window, order)
        x = np.vander(np.arange(window, dtype=float) - window // 2, order + 1)
        assert np.allclose(np.array(rows) / below, x @ np.linalg.pinv(x), atol=1e-9)
        assert all(sum(row) == below for row in rows)  # a constant stays


def test_smoothing_rounds_halves_away_from_zero(spark):
    # weights of a line through three points: (5, 2, -1) / 6 at the first
    df = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.0), ("a", 2, 0.1), ("b", 0, -0.5), ("b", 1, 0.0), ("b", 2, -0.1)], "k string, i int, y double")
    got = {r["k"]: r["s"] for r in R.savgol(df, ["k"], "i", "y", 3, 1, "s", places=1).filter("i = 0").collect()}
    assert got == {"a": 0.4, "b": -0.4}
    half = spark.createDataFrame([("c", 0, 0.06), ("c", 1, 0.0), ("c", 2, 0.0)], "k string, i int, y double")
    assert [r["s"] for r in R.savgol(half, ["k"], "i", "y", 3, 1, "s", places=1).orderBy("i").collect()] == [0.1, 0.0, 0.0]


def test_savgol_short_series_is_null_and_cubic_unchanged(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(6)], "k string, spc int, y double")
    assert all(r["y_s"] is None for r in R.savgol(df, ["k"], "spc", "y", 7, 3, "y_s").collect())
    cub = [(("c", i, 0.5 * i ** 3 - 2 * i + 1.0)) for i in range(9)]
    d2 = spark.createDataFrame(cub, "k string, spc int, y double")
    got = [r["y_s"] for r in R.savgol(d2, ["k"], "spc", "y", 7, 3, "y_s").orderBy("spc").collect()]
    assert np.allclose(got, [c[2] for c in cub], atol=1e-8)


def test_gmean_rms_row_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 0.0), ("b", 3.0), ("c", None), ("c", 2.0)], "k string, x double")
    got = {r["k"]: (r["g"], r["r"]) for r in df.groupBy("k").agg(R.gmean("x").alias("g"), R.rms("x").alias("r")).collect()}
    assert abs(got["a"][0] - 2.0) < 1e-12 and got["b"][0] == 0.0 and got["c"][0] is None
    assert got["c"][1] is None and abs(got["a"][1] - np.sqrt(8.5)) < 1e-12
    w = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r["m"] for r in w.select(R.row_mean(["a", "b", "c"]).alias("m")).collect()] == [2.0, None]


def test_argmax_first_index_wins_ties(spark):
    df = spark.createDataFrame(
        [("d", 1, 0, 0.5, 1), ("d", 1, 1, 0.5, 1), ("d", 2, 0, 0.1, 1), ("d", 2, 1, 0.9, 1)],
        "dataset string, example_id long, cand_idx int, p_true double, label int",
    )
    got = {r["example_id"]: r["pred"] for r in SCR.argmax_candidates(df).collect()}
    assert got == {1: 0, 2: 1}


def test_binary_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "pred int, label int")
    r = SCR.binary_metrics(df).first()
    assert r["accuracy"] == 1.0 and r["f1"] == 0.0 and r["precision"] == 0.0 and r["recall"] == 0.0


def test_pandas_scorer_runs_user_function(spark):
    score = SCR.pandas_scorer(lambda xs: [len(x) / 10.0 for x in xs], batch_size=2)
    df = spark.createDataFrame([("abc",), ("abcdefghij",)], "statement string")
    assert sorted(r["p_true"] for r in score(df).collect()) == [0.3, 1.0]


def test_shot_correlation_pairwise(spark):
    rows = [(spc, "d", shot, float(spc) * (1 if shot == "0" else 2)) for spc in (1, 2, 3) for shot in ("0", "32")]
    df = spark.createDataFrame(rows, "SPC int, dataset string, shot string, Mean double")
    got = {(r["shot_a"], r["shot_b"]): r["corr"] for r in R.shot_correlation(df).collect()}
    assert abs(got[("0", "32")] - 1.0) < 1e-12


def test_fit_save_load_scorer_roundtrip(spark, tmp_path):
    rows = [(f"the sky is blue {i}", 1) for i in range(20)] + [(f"the sky is green {i}", 0) for i in range(20)]
    train = spark.createDataFrame(rows, "statement string, is_true int")
    model = SCR.fit_scorer(train, num_features=1 << 10, max_iter=10)
    path = str(tmp_path / "scorer")
    SCR.save_scorer(model, path)
    loaded = SCR.load_scorer(path)
    test = spark.createDataFrame([("the sky is blue now",), ("the sky is green now",)], "statement string")
    p = {r["statement"]: r["p_true"] for r in SCR.model_scorer(loaded)(test).collect()}
    assert set(test.columns) | {"p_true"} == set(SCR.model_scorer(loaded)(test).columns)
    assert p["the sky is blue now"] > 0.5 > p["the sky is green now"]


def test_scorers_share_one_pass_and_keep_their_own_state(spark, tmp_path):
    rows = [(f"the sky is blue {i}", 1) for i in range(20)] + [(f"the sky is green {i}", 0) for i in range(20)]
    train = spark.createDataFrame(rows, "statement string, is_true int")
    first, second = (SCR.fit_scorer(train, num_features=1 << 10, max_iter=n) for n in (10, 2))
    third = SCR.fit_scorer(train.filter("statement NOT LIKE '% 1%'"), num_features=1 << 8, max_iter=4)
    SCR.save_scorer(first, str(tmp_path / "scorer"))
    models = {"a": first, "a2": SCR.load_scorer(str(tmp_path / "scorer")), "b": second, "c": third}
    test = spark.createDataFrame([(1, "the sky is blue now"), (2, "The sky: green!"), (2, "The sky: green!"), (None, "")], "id int, statement string")
    out = SCR.model_scorers(models)(test)
    assert out.columns == ["id", "statement", *models]
    for name, model in models.items():
        alone = [tuple(r) for r in SCR.model_scorer(model)(test).select("id", "statement", "p_true").collect()]
        assert [tuple(r) for r in out.select("id", "statement", name).collect()] == alone
    assert len({r["a"] for r in out.collect()} & {r["b"] for r in out.collect()}) == 0
    # a statement is split into tokens once for the models that do it alike
    plan = SCR.model_scorers({k: models[k] for k in ("a", "a2", "b")})(test)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(statement") == 1
