"""Sweeps select by key; their corpora come back with whole statements."""

from claimforge.operators import ablation as AB
from claimforge.operators.corpus import built, chosen_statements, sample_tasks, statement_keys

TASKS = ["qqp", "massive", "dpr", "race", "mnli"]


def _rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def test_selected_rows_get_their_whole_statements(spark, views):
    sample = sample_tasks(views, TASKS, 40, 42)
    keys, whole = statement_keys(sample, 40, 2, 42), built(sample, 40, 2, 42)
    assert "statement" not in keys.columns
    plan = AB.constant_budget(AB.ablation_plan(spark, [["qqp"], ["dpr"]]), len(TASKS), 300)
    for setting, select in (
        ("spc", lambda st: AB.spc_sweep(st, [10, 60], 42)),
        ("ppc", lambda st: AB.ppc_sweep(st, [1, 2], 30, 42)),
        ("variant", lambda st: AB.ablation_corpora(st, plan, 42)),
    ):
        got, want = AB.sweep_statements(sample, select(keys), setting, "held_by", 40, 2, 42), select(whole)
        settings = [r[0] for r in want.select(setting).distinct().collect()]
        assert len(settings) > 1 and got.count() == got.select("task", "sample_idx", "template_id").distinct().count()
        for k in settings:
            rows = _rows(AB.corpus_of(got, "held_by", k))
            assert rows and rows == _rows(want.filter(want[setting] == k).drop(setting))


def test_only_chosen_templates(spark, views):
    sample = sample_tasks(views, TASKS, 30, 1)
    whole = built(sample, 30, 3, 1)
    some = whole.filter("(sample_idx + template_id) % 3 = 0").select("task", "sample_idx", "template_id")
    got = chosen_statements(sample, some, 30, 3, 1)
    assert _rows(got) == _rows(whole.join(some, ["task", "sample_idx", "template_id"], "left_semi")) != []


def test_tasks_of_a_view_share_reads(views):
    """Samples and bootstraps in one call are those of each task alone."""
    n = views.bin().count() - 5
    for tasks, size in ((["yelp_polarity", "offensive", "race"], n), (["mintaka", "samsum", "snli"], 10_000)):
        both = sample_tasks(views, tasks, size, 7, write=False)
        for t in tasks:
            alone = sample_tasks(views, [t], size, 7)[t]
            assert _rows(both[t].select("id", "sample_idx", "source_id")) == _rows(alone.select("id", "sample_idx", "source_id"))
            assert alone.count() == size
