"""File scans and sinks on files shaped like the modelled result and speed CSVs."""

import os
import tempfile

from claimforge.sources import results as IO


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_scan_results_dir_nulls_and_file_names(spark):
    root = tempfile.mkdtemp(prefix="cf-results-")
    header = "model,shot,SPC,PPC,excluded,dataset,Mean,std,speed\n"
    _write(os.path.join(root, "1-PPC.csv"), header + 'm,0,4000,1,None,copa,0.75,0.02,500.0\n')
    _write(os.path.join(root, "a,b-EXCLUDE.csv"), header + 'm,0,5000,5,"a,b",copa,0.7,,510.5\n')
    _write(os.path.join(root, "notes.txt"), "not a result file\n")
    rows = sorted(IO.scan_results_dir(spark, root).collect(), key=lambda r: r["SPC"])
    assert len(rows) == 2
    assert rows[0]["excluded"] is None and rows[0]["std"] == 0.02 and rows[0]["file"] == "1-PPC.csv"
    assert rows[1]["excluded"] == "a,b" and rows[1]["std"] is None and rows[1]["file"] == "a,b-EXCLUDE.csv"


def test_scan_results_by_name_with_index_column_and_other_orders(spark):
    root = tempfile.mkdtemp(prefix="cf-results-")
    _write(os.path.join(root, "1-PPC.csv"), ",model,shot,SPC,PPC,excluded,dataset,Mean,std,speed\n0,m-base,0,4000,1,None,copa,0.75,0.02,500.0\n1,m-base,32,4000,1,None,copa,0.8,,\n")
    _write(os.path.join(root, "x/2-PPC.csv"), 'dataset,Mean,model,shot,excluded,SPC,PPC,extra\n"co,pa",0.5,n,full,"a,b",1000,2,zzz\n')
    rows = {(r["model"], r["shot"]): r for r in IO.scan_results_dir(spark, root).collect()}
    assert len(rows) == 3
    r = rows["m-base", "0"]
    assert (r["SPC"], r["PPC"], r["excluded"], r["dataset"], r["Mean"], r["std"], r["speed"], r["file"]) == (4000, 1, None, "copa", 0.75, 0.02, 500.0, "1-PPC.csv")
    r = rows["n", "full"]
    assert (r["dataset"], r["Mean"], r["excluded"], r["SPC"], r["std"], r["speed"]) == ("co,pa", 0.5, "a,b", 1000, None, None)


def test_scan_results_with_line_breaks_and_quotes(spark):
    root = tempfile.mkdtemp(prefix="cf-results-")
    _write(os.path.join(root, "1.csv"), 'model,dataset,Mean,excluded\n"m\nbase","co""pa",0.5,"a,\nb"\nplain,mrpc,0.25,\n')
    _write(os.path.join(root, "2.csv"), 'Mean,excluded,dataset,shot,model\n0.75,None,"x\n\ny",32,"q ""r"""\n')
    rows = {r["Mean"]: r for r in IO.scan_results_dir(spark, root).collect()}
    assert (rows[0.5]["model"], rows[0.5]["dataset"], rows[0.5]["excluded"]) == ("m\nbase", 'co"pa', "a,\nb")
    assert (rows[0.25]["model"], rows[0.25]["excluded"], rows[0.25]["shot"]) == ("plain", None, None)
    assert (rows[0.75]["model"], rows[0.75]["dataset"], rows[0.75]["shot"], rows[0.75]["excluded"]) == ('q "r"', "x\n\ny", "32", None)
    out = os.path.join(tempfile.mkdtemp(prefix="cf-out-"), "r.csv")
    IO.write_results(IO.scan_results_dir(spark, root).drop("file", "variant"), out)
    again = {r["Mean"]: r["model"] for r in IO.scan_results_dir(spark, os.path.dirname(out)).collect()}
    assert again == {k: r["model"] for k, r in rows.items()}


def test_scan_speed_files_with_other_column_orders(spark):
    root = tempfile.mkdtemp(prefix="cf-speeds-")
    _write(os.path.join(root, "a-speeds.csv"), ",copa,mrpc\nm1,1.0,2.0\n")
    _write(os.path.join(root, "b-speeds.csv"), "model,mrpc,copa,extra\nm2,2.0,1.0,\nm3,,,7\n")
    rows = {r["model"]: r for r in IO.scan_speed_files(spark, os.path.join(root, "*speeds*")).collect()}
    assert (rows["m1"]["copa"], rows["m1"]["mrpc"], rows["m1"]["extra"]) == (1.0, 2.0, None)
    assert (rows["m2"]["copa"], rows["m2"]["mrpc"]) == (1.0, 2.0)
    assert (rows["m3"]["copa"], rows["m3"]["extra"]) == (None, 7.0)


def test_scan_speed_files_unnamed_model_column(spark):
    root = tempfile.mkdtemp(prefix="cf-speeds-")
    _write(os.path.join(root, "decoder-speeds-a.csv"), ",copa,mrpc\norg/a,1.5,2.5\n")
    _write(os.path.join(root, "decoder-speeds-b.csv"), ",copa,mrpc\nb,3.0,4.0\n")
    _write(os.path.join(root, "other.csv"), ",copa,mrpc\nzzz,0,0\n")
    df = IO.scan_speed_files(spark, os.path.join(root, "*speeds*"))
    assert df.columns[0] == "model"
    assert sorted(r["model"] for r in df.collect()) == ["b", "org/a"]


def test_write_and_read_results_roundtrip(spark):
    rows = [("m", "0", 4000, 5, None, "copa", 0.123456789, None, 10.0 / 3)]
    df = spark.createDataFrame(rows, IO.RESULT_SCHEMA)
    path = os.path.join(tempfile.mkdtemp(prefix="cf-out-"), "exp.csv")
    IO.write_results(df, path)
    IO.write_results(df, path + "-shuffled.csv", variant="shuffled")
    back = IO.scan_results_dir(spark, os.path.dirname(path)).drop("file").collect()
    assert sorted(tuple(r) for r in back) == [(*rows[0], "plain"), (*rows[0], "shuffled")]


def test_read_wide_baseline_renames_full_column(spark):
    root = tempfile.mkdtemp(prefix="cf-wide-")
    _write(os.path.join(root, "size_ablation.csv"), "eval_set,model,full_shot,shot_0\ncopa,base,80.5%,50%\n")
    df = IO.read_wide_baseline(spark, os.path.join(root, "size_ablation.csv"))
    assert df.columns == ["eval_set", "model", "full_3000_shot", "shot_0"]


def test_splits_with_a_declared_schema(spark, tmp_path):
    import pytest

    from claimforge.sources import tables as T

    df = spark.range(30).selectExpr("id", "named_struct('text', array('a', 'b'), 'more', 1) as answers", "cast(id % 4 - 1 as int) as label", "concat('s', id % 3) as split", "1 as other")
    df.write.partitionBy("split").parquet(f"{tmp_path}/qa.parquet")
    T.declare("qa", "id bigint, answers struct<text: array<string>>, label int", {"label": ["no", "yes"]})
    got = T.load_splits(spark, str(tmp_path), "qa", ["s0", "s2"])
    assert got.columns == ["id", "answers", "label", "split"] and got.count() == 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "split" in plan.split("PartitionFilters: [")[1].split("]")[0]
    names = {(r["label"], r["label_name"]) for r in T.with_class_names(got, "qa").collect()}
    assert names == {(-1, None), (0, "no"), (1, "yes"), (2, None)}
    with pytest.raises(ValueError):
        T.load_splits(spark, str(tmp_path), "qa", ["s0", "s9"])
    for wrong in ("id int", "id bigint, gone string", "answers struct<text: array<int>>", "answers struct<none: int>", "label struct<x: int>"):
        T.declare("qa", wrong)
        with pytest.raises(T.SchemaError):
            T.load_splits(spark, str(tmp_path), "qa", "s0")


def test_scorer_store_reads_whole_versions_only(spark, tmp_path):
    import os

    import pytest

    from claimforge.operators import scoring as SCR

    train = spark.createDataFrame([(f"good {k}" if k % 2 else f"bad {k}", k % 2) for k in range(40)], "statement string, is_true int")
    first, second = (SCR.fit_scorer(train, 64, steps) for steps in (1, 8))
    store = SCR.ScorerStore(spark, f"{tmp_path}/store")
    assert store.runs() == []
    store.save(first, 3)
    at = store.save(second, 3)
    store.save(first, 1)
    os.makedirs(f"{tmp_path}/store/run=3/99999999999999999999-cut/model")  # a save that did not end
    os.makedirs(f"{tmp_path}/store/run=7/1-cut/model")
    assert store.runs() == [1, 3] and len(store.versions(3)) == 2
    score = lambda m: [r["p_true"] for r in SCR.model_scorer(m)(train).orderBy("statement").collect()]
    assert score(store.load(3)) == score(second) != score(first) == score(store.load(1))
    assert at.endswith(store.versions(3)[-1]) and score(store.load(3, store.versions(3)[0])) == score(first)
    for run, version in ((7, None), (3, "none")):
        with pytest.raises(FileNotFoundError):
            store.load(run, version)
