import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossledger.functions.dates import days_until, month_of, tenure_months
from lossledger.functions.numbers import round_half_even
from lossledger.functions.text import WHITESPACE, is_blank, segment_label
from lossledger.operators.scoring import risk_tier, rule_churn_propensity, rule_win_propensity, score_table
from lossledger.plans import views
from tests.conftest import rows
from tests.test_features import usage, week

ACCOUNTS = (
    "account_id string, company_size string, industry string, region string, plan_type string, monthly_revenue double"
)


def test_tiers(spark):
    cases = [(-0.5, None), (-0.01, None), (0.0, "Low"), (0.25, "Low"), (0.2500001, "Medium"), (0.5, "Medium"),
             (0.75, "High"), (1.0, "Critical"), (1.01, None), (None, None)]
    df = spark.createDataFrame([(p,) for p, _ in cases], "p double")
    assert [r[0] for r in rows(df.select(risk_tier(F.col("p"))))] == [t for _, t in cases]


def test_rounding_matches_numpy(spark):
    values = [0.125, 0.375, 1.005, 2.675, -0.125, -2.5, 0.0, 1234512.125, 99.995]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in rows(df.select(round_half_even(F.col("x"))))] == np.round(values, 2).tolist()


def test_dates(spark):
    d = dt.date
    df = spark.createDataFrame([
        (d(2025, 3, 31), d(2025, 1, 1)), (d(2025, 1, 1), d(2025, 1, 1)), (d(2024, 1, 1), d(2025, 1, 1)), (None, d(2025, 1, 1)),
    ], "ended date, started date")
    got = rows(df.select(
        tenure_months(F.col("ended"), F.col("started")), month_of(F.col("ended")), days_until(d(2025, 1, 11), F.col("ended"))))
    assert got == [(2, "2025-03", 0), (1, "2025-01", 10), (1, "2024-01", 376), (None, None, None)]


def test_blank_agrees_with_stripping(spark):
    texts = [*WHITESPACE, WHITESPACE, "a", " a ", "\x0b.", "", "​", "﻿", "x" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows(df.select(is_blank(F.col("t"))))] == [not t.strip() for t in texts]


def test_segment_label(spark):
    df = spark.createDataFrame([("pro", None, "media")], "a string, b string, c string")
    assert rows(df.select(segment_label(F.col("a"), F.col("b"), F.col("c")))) == [("pro | nan | media",)]


def test_churn_propensity(spark):
    accounts = spark.createDataFrame([
        ("a1", "s", "i", "r", "pro", 24.0), ("a2", "s", "i", "r", "team", 180.0), ("a3", "s", "i", "r", "free", 0.0),
        ("a4", "s", "i", "r", "team", 179.0), ("a5", "s", "i", "r", "pro", None),
    ], ACCOUNTS)
    used = usage(spark, [("a2", week(0), 2, 1), ("a2", week(1), 2, 2), ("a4", week(0), 5, 5)])
    got = dict(rows(rule_churn_propensity(accounts, used).select("account_id", "churn_probability")))
    assert got == {"a1": 0.29, "a2": 0.19, "a3": 0.0, "a4": 0.14, "a5": 0.0}


def test_win_propensity(spark):
    accounts = spark.createDataFrame([("a1", "mid_market", "i", "r", "p", 1.0), ("a2", "solo", "i", "r", "p", 1.0)], ACCOUNTS)
    deals = spark.createDataFrame([
        ("d1", "a1", "Canva", 20, "referral", 100.0), ("d2", "a2", "None", 0, "ads", 100.0), ("d3", "zz", None, 25, "ads", 8.0),
    ], "deal_id string, account_id string, competitor_mentioned string, discount_pct int, lead_source string, deal_value double")
    got = {r[0]: r[1:] for r in rows(rule_win_propensity(deals, accounts).select("deal_id", "win_probability", "expected_value"))}
    assert got["d1"] == (0.43, pytest.approx(34.4)) and got["d2"] == (0.58, pytest.approx(58.0)) and got["d3"] == (0.53, pytest.approx(3.18))


def scored(spark, data):
    return score_table(spark.createDataFrame(
        [(a, m, "pro", "Asia", "media", p) for a, m, p in data],
        "account_id string, monthly_revenue double, plan_type string, region string, industry string, churn_probability double"))


def test_score_order_and_threshold(spark):
    df = scored(spark, [("b", 10.0, 0.5), ("a", 10.0, 0.5), ("c", 100.0, 0.1), ("d", 5.0, 1.0)])
    assert [r[0] for r in rows(df.select("account_id"))] == ["c", "d", "a", "b"]
    # Exactly 0.5 is tier Medium, yet counts as high risk.
    kpis = views.risk_kpis(df).first()
    assert kpis["critical_accounts"] == 3
    assert [r[0] for r in rows(views.top_at_risk(df, 0.5, n=2).select("account_id"))] == ["d", "a"]


def test_views_on_filters(spark):
    df = scored(spark, [("a", 10.0, 0.5)])
    assert views.choose(df, ["team"], None).count() == 0
    assert views.choose(df, ["pro"], ["Asia"]).count() == views.choose(df).count() == 1
    assert views.choose(df, [], None).count() == 0
    assert rows(views.filter_options(df)) == [("plan_type", "pro"), ("region", "Asia")]
    assert rows(views.risk_kpis(df.where("false"))) == [(0.0, 0, None)]


def test_metrics_long_fills_what_is_missing(spark):
    df = spark.createDataFrame([(0.6539, None)], "roc_auc double, recall double")
    got = rows(views.metrics_long(df))
    assert [r[0] for r in got] == list(views.METRICS)
    assert got[0] == ("roc_auc", "ROC_AUC", 0.6539) and all(r[2] == 0.0 for r in got[1:])
    assert rows(views.quality_row(df)) == [(0.6539, 0.0, 0.0, 0.0, 0.0)]
