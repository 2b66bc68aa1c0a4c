import datetime as dt

import pytest

from lossledger.operators import features
from lossledger.operators.features import CATEGORICAL, LABEL, NUMERIC, account_features, recent_means, recent_weeks
from lossledger.sources.tables import Tables
from tests.conftest import final_plan, planned, rows

AS_OF = dt.date(2026, 3, 12)
USAGE = (
    "account_id string, week_start date, projects_created int, templates_used int, ai_design_tool_usage int, "
    "exports_count int, collaboration_sessions int, weekly_active_users int"
)


def week(n):
    return dt.date(2025, 1, 6) + dt.timedelta(weeks=n)


def usage(spark, data):
    return spark.createDataFrame([(a, w, p, 1, 1, 1, 1, u) for a, w, p, u in data], USAGE)


@pytest.fixture()
def tables(spark):
    return Tables(
        accounts=spark.createDataFrame(
            [
                ("a1", "solo", "media", "Asia", "pro", dt.date(2026, 3, 2), 24.0),
                ("a2", "solo", "media", "Asia", "pro", None, None),
                ("a3", None, None, None, None, dt.date(2027, 1, 1), 10.0),
                ("a4", "solo", "media", "Asia", "pro", AS_OF, 1.0),
            ],
            "account_id string, company_size string, industry string, region string, plan_type string, "
            "signup_date date, monthly_revenue double",
        ),
        deals=spark.createDataFrame(
            [
                ("d1", "a1", "lost", 20, 100.0, "Canva"),
                ("d2", "a1", "won", 0, 50.5, "None"),
                ("d3", "a1", "won", None, None, None),
                ("d4", "a4", "won", 10, 10.0, "Figma"),
            ],
            "deal_id string, account_id string, deal_status string, discount_pct int, deal_value double, "
            "competitor_mentioned string",
        ),
        usage=usage(spark, [("a1", week(3), 4, 40), ("a1", week(0), 1, 10), ("a1", week(5), 6, 60),
                            ("a1", week(1), 2, 20), ("a1", week(4), 5, None), ("a1", week(2), 3, 30),
                            ("a3", week(0), 7, 70), ("a3", week(1), 8, 80)]),
        support=spark.createDataFrame(
            [
                ("t1", "a1", "high", "billing", 10, 1),
                ("t2", "a1", "low", "performance_issue", 20, None),
                ("t3", "a1", None, None, None, 3),
            ],
            "ticket_id string, account_id string, priority string, ticket_type string, resolution_hours int, "
            "csat_score int",
        ),
        notes=spark.createDataFrame([], "note_id string"),
        cancellations=spark.createDataFrame([("a1",), ("a1",), ("gone",)], "account_id string"),
    )


def by_account(df):
    return {r["account_id"]: r.asDict() for r in df.collect()}


def test_feature_table(tables):
    df = account_features(tables, AS_OF)
    assert len(df.columns) == 30
    assert df.columns == ["account_id", *CATEGORICAL, "signup_date", *NUMERIC, LABEL]
    got = by_account(df)
    a1 = got["a1"]
    assert a1["avg_projects_created"] == 3.5
    assert a1["recent_projects_created"] == 4.5  # weeks 2 to 5, whatever the row order
    assert a1["recent_weekly_active_users"] == pytest.approx(130 / 3)  # the null week counts as one of the four
    assert a1["avg_weekly_active_users"] == 32.0
    assert (a1["ticket_count"], a1["high_priority_tickets"], a1["billing_tickets"]) == (3, 1, 1)
    assert (a1["performance_tickets"], a1["feature_request_tickets"]) == (1, 0)
    assert (a1["avg_resolution_hours"], a1["avg_csat"]) == (15.0, 2.0)
    assert (a1["total_deals"], a1["lost_deals"]) == (3, 1)
    assert a1["lost_deal_rate"] == pytest.approx(1 / 3)
    assert a1["competitor_mention_rate"] == pytest.approx(1 / 3)
    assert (a1["avg_discount_pct"], a1["avg_deal_value"]) == (10.0, 75.25)
    assert (a1["is_churned"], a1["account_age_days"]) == (1, 10)


def test_sparse_accounts_are_zero_filled(tables):
    got = by_account(account_features(tables, AS_OF))
    assert all(got["a2"][c] == 0 for c in NUMERIC) and got["a2"][LABEL] == 0
    assert got["a3"]["recent_projects_created"] == 7.5  # fewer than four weeks
    assert (got["a3"]["account_age_days"], got["a4"]["account_age_days"]) == (0, 0)
    assert got["a3"]["plan_type"] is None
    assert "gone" not in got


def test_nulls_can_be_kept(tables):
    got = by_account(account_features(tables, AS_OF, fill=None))
    assert got["a2"]["ticket_count"] is None and got["a2"]["account_age_days"] is None
    assert got["a3"]["total_deals"] is None and got["a3"]["lost_deal_rate"] is None
    assert got["a4"]["total_deals"] == 1 and got["a4"]["lost_deals"] == 0
    assert got["a4"]["avg_projects_created"] is None and got["a1"]["monthly_revenue"] == 24.0


def test_combined_activity_equals_the_single_summaries(spark, tables):
    together = by_account(features.account_activity(tables))
    for alone in (
        features.usage_means(tables.usage),
        features.recent_means(tables.usage),
        features.support_summary(tables.support),
        features.deal_summary(tables.deals),
        features.churn_labels(tables.cancellations),
    ):
        for account, row in by_account(alone).items():
            assert {k: together[account][k] for k in row} == row


def test_duplicate_weeks(spark):
    data = [("a", week(5), 9, 1), ("a", week(5), 9, 1), ("a", week(4), 1, 1), ("a", week(3), 1, 1), ("a", week(2), 50, 1)]
    assert rows(recent_means(usage(spark, data)))[0][1] == 5.0


@pytest.mark.parametrize("partitions", [1, 7])
def test_recent_weeks_do_not_depend_on_partitions(spark, partitions):
    data = [(f"a{i % 5}", week(i % 9), i % 4, i % 3) for i in range(300)]
    df = usage(spark, data)
    assert sorted(map(repr, rows(recent_weeks(df.repartition(partitions))))) == sorted(map(repr, rows(recent_weeks(df))))


def test_recent_weeks_prune_before_the_shuffle(spark):
    plan = planned(recent_weeks(usage(spark, [("a", week(0), 1, 1)])))
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]


def test_activity_is_one_aggregation(tables):
    plan = final_plan(features.account_activity(tables))
    # The window's shuffle of recent weeks and the shuffle of the combined partial aggregates.
    assert plan.count("+- Exchange hashpartitioning(account_id") == 2
    assert "Join" not in plan
