"""Driver contract and DuckDB parity on a representative subset of keys (sf0.001)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from conftest import SF_SMALL  # noqa: E402

FAST_KEYS = [
    "sample_exact", "bootstrap_exact", "stratified_test_cap", "uniform_20", "build_pair_compare", "build_substitution",
    "build_lettered_choice", "eval_cause_effect", "eval_topic_candidates", "shuffle_words", "argmax_two",
    "accuracy_by_dataset", "run_summary", "pooled_summary", "savgol_smooth", "shot_correlation", "baseline_delta",
    "format_cell", "max_token_filter", "melt_wide", "render_prompt",
]


def test_contract_shapes():
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    from claimforge.plans.registry import ORACLE, QUERIES

    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(qs)
    assert len(QUERIES) >= 100


def test_entry_runs(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert {"task", "n_statements", "n_true", "share_true"} <= set(df.columns)
    assert len(rows) == 16 and all(r["n_statements"] == 4000 for r in rows)


@pytest.mark.parametrize("key", FAST_KEYS)
def test_oracle_parity(spark, key):
    import __spark_entry__ as E
    from oracle_check import compare, duck

    con = duck(SF_SMALL)
    res = compare(spark, SF_SMALL, key, E.queries()[key], E.oracle_sql()[key], con)
    assert res["ok"], res
