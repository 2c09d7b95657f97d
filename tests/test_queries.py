"""The driver contract, and a sample of registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "distractor_vulnerability_by_tier", "dialect_number_on_texts", "primary_secondary_summary", "role_description_confusion",
    "frequency_shortcut", "action_long_tail", "group_split", "stratified_clips", "one_shot_references", "preference_pairs_hard_mining",
    "inverted_questions", "negative_questions", "labelled_bank", "log_accuracy", "running_accuracy"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 150
    assert entry.entry(spark).columns == ["model", "tier", "label", "n", "errors", "share"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_hot_paths_push_filters_and_prune(spark):
    df = entry.queries()["questions_left_to_answer"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and not any("option_hardness" in line or "group_id" in line for line in scans)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_query_plans_a_cross_join(spark):
    for name in ("frequency_shortcut", "candidates_outside_group", "donor_clips", "negative_questions", "label_shift"):
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
