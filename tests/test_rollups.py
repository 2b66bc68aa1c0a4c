import datetime as dt

import pytest
from pyspark.sql import functions as F

from lossledger.operators.ledger import loss_events, loss_ledger
from lossledger.operators.recommend import PLAYBOOK, recommend
from lossledger.operators.rollups import (
    loss_summary,
    loss_trend,
    percent_of_total,
    reconcile,
    segment_loss,
)
from lossledger.plans import views
from tests.conftest import rows

# A published breakdown of 14 rows and what follows from it.
BREAKDOWN = [
    ("Product", "missing_templates", "lost_deal", 1041, 650007.0, 39.46),
    ("Product", "missing_features", "lost_deal", 526, 350904.0, 21.3),
    ("Competitive", "competitor_switch", "lost_deal", 546, 312054.0, 18.94),
    ("Commercial", "pricing_concerns", "lost_deal", 232, 160347.0, 9.73),
    ("Operational", "onboarding_confusion", "lost_deal", 233, 156780.0, 9.52),
    ("Commercial", "pricing_concerns", "churn", 48, 3732.0, 0.23),
    ("Product", "performance_reliability", "churn", 23, 2634.0, 0.16),
    ("Product", "missing_templates", "churn", 25, 2574.0, 0.16),
    ("Adoption / Value Realization", "low_usage", "churn", 18, 1854.0, 0.11),
    ("Competitive", "competitor_advantage", "churn", 22, 1842.0, 0.11),
    ("Competitive", "competitor_switch", "churn", 19, 1548.0, 0.09),
    ("Operational", "onboarding_confusion", "churn", 24, 1206.0, 0.07),
    ("Operational", "support_quality", "churn", 14, 972.0, 0.06),
    ("Uncategorized", "unclear_signal", "churn", 21, 900.0, 0.05),
]
RECOMMENDED = [
    (1, "Product", 1006119.0, 1615),
    (2, "Competitive", 315444.0, 587),
    (3, "Commercial", 164079.0, 280),
    (4, "Operational", 158958.0, 271),
    (5, "Adoption / Value Realization", 1854.0, 18),
]
SUMMARY = "category string, subcategory string, source string, source_records bigint, lost_revenue double, pct_of_total_loss double"

JAN, FEB, MAR = dt.date(2025, 1, 31), dt.date(2025, 2, 1), dt.date(2025, 3, 5)


def summary(spark):
    return spark.createDataFrame(BREAKDOWN, SUMMARY)


def cancellations(spark, data):
    return spark.createDataFrame(
        data,
        "cancellation_id string, account_id string, cancellation_date date, category string, subcategory string, "
        "churned_revenue double",
    )


def deals(spark, data):
    return spark.createDataFrame(
        data,
        "deal_id string, account_id string, close_date date, deal_status string, deal_loss_category string, "
        "deal_loss_subcategory string, deal_value double, discount_pct int",
    ).withColumn("effective_deal_value", F.expr("deal_value * (1 - discount_pct / 100D)"))


def accounts(spark, data):
    return spark.createDataFrame(data, "account_id string, plan_type string, region string, industry string")


def sample(spark):
    c = cancellations(spark, [
        ("c1", "a1", JAN, "Product", "x", 10.005),
        ("c2", "a1", JAN, "Product", "x", 20.0),
        ("c3", "a2", None, "Product", "y", 5.0),
        ("c4", "nobody", FEB, "Product", "x", 1.0),
    ])
    d = deals(spark, [
        ("d1", "a1", FEB, "lost", "Product", "x", 100.0, 10),
        ("d2", "a3", MAR, "lost", "Commercial", "z", 50.0, 0),
        ("d3", "a2", MAR, "won", "Commercial", "z", 999.0, 0),
        ("d4", None, None, "lost", "Commercial", "z", 7.0, None),
    ])
    a = accounts(spark, [
        ("a1", "pro", "Asia", "media"), ("a2", None, "Asia", "media"), ("a3", None, "Asia", "media")])
    return c, d, a


def test_percent_of_published_breakdown(spark):
    got = percent_of_total(summary(spark).drop("pct_of_total_loss"), "lost_revenue", "pct")
    assert {r[:3]: r[5] for r in rows(got)} == {r[:3]: r[5] for r in BREAKDOWN}


def test_recommendations_of_published_breakdown(spark):
    got = rows(recommend(summary(spark)))
    assert [r[:4] for r in got] == RECOMMENDED
    assert [r[4] for r in got] == [PLAYBOOK[r[1]] for r in got]


def test_unknown_category_gets_the_default_action(spark):
    odd = spark.createDataFrame([("Other", "x", "churn", 1, 5.0, 100.0), (None, "x", "churn", 1, 9.0, 0.0)], SUMMARY)
    assert [(r[0], r[1], r[4]) for r in rows(recommend(odd))] == [(1, "Other", PLAYBOOK["Uncategorized"])]


def test_top_n(spark):
    assert [r[0] for r in rows(recommend(summary(spark), top_n=2))] == [1, 2]


def test_summary(spark):
    c, d, _ = sample(spark)
    got = {r[:3]: r[3:] for r in rows(loss_summary(loss_ledger(d, c)))}
    assert got[("Product", "x", "churn")][:2] == (3, 31.0)  # 31.005 rounds to even cents
    assert got[("Product", "y", "churn")][:2] == (1, 5.0)
    assert got[("Product", "x", "lost_deal")][:2] == (1, 90.0)
    assert got[("Commercial", "z", "lost_deal")][:2] == (2, 50.0)
    assert sum(v[2] for v in got.values()) == pytest.approx(100, abs=0.05)


def test_zero_total_has_zero_share(spark):
    c = cancellations(spark, [("c1", "a", JAN, "A", "a", 0.0)])
    got = rows(loss_summary(loss_ledger(deals(spark, []), c)))
    assert got == [("A", "a", "churn", 1, 0.0, 0.0)]


def test_trend_keeps_months_of_one_side_and_undated_losses(spark):
    c, d, _ = sample(spark)
    got = rows(loss_trend(loss_events(d, c)))
    assert [r[0] for r in got] == ["2025-01", "2025-02", "2025-03", None]
    assert got[0][1:] == (30.005, 2, 0.0, 0, 30.005)
    assert got[1][1:] == (1.0, 1, 90.0, 1, 91.0)
    assert got[2][1:] == (0.0, 0, 50.0, 1, 50.0)
    assert got[3][1:] == (5.0, 1, 0.0, 1, 5.0)


def test_segments_merge_null_keys_of_both_sides(spark):
    c, d, a = sample(spark)
    got = {r[:3]: r[3:] for r in rows(segment_loss(loss_events(d, c), a))}
    assert got[("pro", "Asia", "media")] == (30.005, 2, 90.0, 1, 120.005)
    assert got[(None, "Asia", "media")] == (5.0, 1, 50.0, 1, 55.0)
    assert got[(None, None, None)] == (1.0, 1, 0.0, 1, 1.0)
    assert len(got) == 3


def test_repeated_account_counts_once_per_row(spark):
    c, d, _ = sample(spark)
    twice = accounts(spark, [("a1", "pro", "Asia", "media")] * 2 + [("a1", "team", "Asia", "media")])
    got = {r[0]: r[3:7] for r in rows(segment_loss(loss_events(d, c), twice))}
    joined = loss_events(d, c).join(twice, "account_id", "left")
    plain = {
        r[0]: (float(r[1] or 0), r[2], float(r[3] or 0), r[4])
        for r in rows(joined.groupBy("plan_type").agg(
            F.sum(F.expr("case when source = 'churn' then amount end")),
            F.count_if(F.col("source") == "churn"),
            F.sum(F.expr("case when source = 'lost_deal' then amount end")),
            F.count_if(F.col("source") == "lost_deal"),
        ))
    }
    assert got == plain


def test_views_agree_with_each_other(spark):
    c, d, a = sample(spark)
    ledger, events = loss_ledger(d, c), loss_events(d, c)
    got = rows(reconcile(loss_summary(ledger), loss_trend(events), segment_loss(events, a)))
    assert {r[0] for r in got} == {"churn", "lost_deal"} and all(r[4] for r in got)


def test_more_losses_never_lower_a_total(spark):
    c, d, _ = sample(spark)
    more = c.unionByName(cancellations(spark, [("c9", "a9", JAN, "Product", "x", 3.0)]))
    before = dict(rows(loss_trend(loss_events(d, c)).select("period", "total_revenue_loss")))
    after = dict(rows(loss_trend(loss_events(d, more)).select("period", "total_revenue_loss")))
    assert all(after[p] >= before[p] for p in before)


def test_empty_inputs(spark):
    c, d, a = cancellations(spark, []), deals(spark, []), accounts(spark, [])
    ledger, events = loss_ledger(d, c), loss_events(d, c)
    assert rows(loss_summary(ledger)) == rows(loss_trend(events)) == rows(segment_loss(events, a)) == []
    assert rows(recommend(loss_summary(ledger))) == []
    assert rows(views.source_totals(loss_summary(ledger))) == [(0.0, 0.0)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_sums_do_not_depend_on_partitions(spark, partitions):
    many = spark.range(5000).select(
        F.concat(F.lit("c"), F.col("id")).alias("cancellation_id"),
        F.lit("a").alias("account_id"),
        F.lit(JAN).alias("cancellation_date"),
        F.lit("A").alias("category"),
        F.lit("a").alias("subcategory"),
        (F.col("id") * 0.37 + 0.01).alias("churned_revenue"),
    ).repartition(partitions)
    got = rows(loss_trend(loss_events(deals(spark, []), many)).select("churn_revenue_lost"))
    assert got == [(round(sum(i * 37 + 1 for i in range(5000)) / 100, 2),)]
