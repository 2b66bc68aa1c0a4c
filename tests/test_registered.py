"""Every registered query against its SQL on the smallest driver tables, and plan checks."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as registered
from catalog.registry import QUERIES
from tests.conftest import planned
from tools.compare import check, connect

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")

FOREST = {"m06_forest_nodes", "m06_forest_scores", "m07_bootstrap_weights", "m09_holdout_scores", "m16_train_and_score"}
OWN = sorted(QUERIES)  # the operators with tests of their own have names op... and pipeline


@pytest.fixture(scope="module")
def connection():
    return connect(DATA)


@pytest.mark.parametrize("name", OWN)
def test_same_rows_as_sql(spark, connection, name):
    problem, plan = check(spark, connection, DATA, name)
    assert problem is None
    if name not in FOREST:
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", plan)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_every_query_has_sql():
    assert set(OWN) <= set(registered.oracle_sql())
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = registered.queries()["t05_classified_cancellations"](spark, DATA)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(l_returnflag,R)" in plan
    assert "l_comment" not in plan and "l_tax" not in plan


def test_trend_and_segments_read_no_notes(spark):
    for name in ("a12_loss_trend", "a15_segment_loss"):
        assert "Contains" not in planned(registered.queries()[name](spark, DATA))


def test_joins_read_and_shuffle_no_more_than_they_need(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    lost = planned(registered.queries()["j04_lost_deals_with_account"](spark, DATA))
    assert "l_discount" not in lost and "l_shipdate" not in lost
    best = planned(registered.queries()["j01_deals_with_best_note"](spark, DATA))
    # one for the notes, which the window needs, and one for the deals; the join adds none
    assert best.count("Exchange hashpartitioning(") == 2


def test_rollups_of_one_source_read_that_source_only(spark):
    for name in ("a10_churn_by_month", "a13_churn_by_segment"):
        assert "o_totalprice" not in planned(registered.queries()[name](spark, DATA))


def test_sums_need_no_global_sort(spark):
    for name in ("a19_kpi_snapshot", "s09_run_summary"):
        assert "rangepartitioning" not in planned(registered.queries()[name](spark, DATA))


def test_running_totals_rank_no_keys(spark):
    plan = planned(registered.queries()["m10_precision_recall_curve"](spark, DATA))
    assert "TakeOrdered" not in plan


def test_attribution_counts_every_order(spark):
    got = registered.queries()["t06_attribution_by_category"](spark, DATA)
    assert sum(r["deals"] for r in got.collect()) == spark.read.parquet(f"{DATA}/orders.parquet").where(
        "o_orderstatus = 'F'").count()
