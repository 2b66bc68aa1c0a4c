"""Account feature table: usage, support and deal history next to the account's attributes."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossledger.functions.dates import days_until
from lossledger.functions.numbers import clamp_low, flag, money_mean
from lossledger.operators.attribution import mentions_competitor
from lossledger.settings import AS_OF
from lossledger.sources.tables import Tables

RECENT_WEEKS = 4

# Usage measure -> name of its mean per account.
USAGE_MEANS = {
    "projects_created": "avg_projects_created",
    "templates_used": "avg_templates_used",
    "ai_design_tool_usage": "avg_ai_usage",
    "exports_count": "avg_exports",
    "collaboration_sessions": "avg_collaboration",
    "weekly_active_users": "avg_weekly_active_users",
}
RECENT_MEANS = {
    "projects_created": "recent_projects_created",
    "weekly_active_users": "recent_weekly_active_users",
}
TICKET_COUNTS = [
    "ticket_count",
    "high_priority_tickets",
    "performance_tickets",
    "billing_tickets",
    "feature_request_tickets",
]
DEAL_COUNTS = ["total_deals", "lost_deals"]

CATEGORICAL = ["company_size", "industry", "region", "plan_type"]
NUMERIC = [
    "monthly_revenue",
    *USAGE_MEANS.values(),
    *RECENT_MEANS.values(),
    "ticket_count",
    "avg_resolution_hours",
    "avg_csat",
    "high_priority_tickets",
    "performance_tickets",
    "billing_tickets",
    "feature_request_tickets",
    "total_deals",
    "lost_deals",
    "avg_discount_pct",
    "avg_deal_value",
    "competitor_mention_rate",
    "lost_deal_rate",
    "account_age_days",
]
LABEL = "is_churned"


def recent_weeks(usage: DataFrame, weeks: int = RECENT_WEEKS) -> DataFrame:
    """The newest ``weeks`` usage rows of each account.

    The measures break ties between rows of one week, so rows that still tie are equal. The rank
    filter keeps ``weeks`` rows per account in each map task before the shuffle.
    """
    order = Window.partitionBy("account_id").orderBy(
        F.col("week_start").desc_nulls_last(),
        *(F.col(m).desc_nulls_last() for m in RECENT_MEANS),
    )
    return (
        usage.select("account_id", "week_start", *RECENT_MEANS)
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= weeks)
        .drop("_rank")
    )


# Each source below has one list of rows to contribute and one list of aggregates over them. The
# same aggregates serve the single-source summaries and the combined table.


def _usage_aggregates() -> list[Column]:
    return [F.avg(m).alias(name) for m, name in USAGE_MEANS.items()]


def _recent_aggregates() -> list[Column]:
    return [F.avg(f"_recent_{m}").alias(name) for m, name in RECENT_MEANS.items()]


def _support_aggregates() -> list[Column]:
    return [
        F.count("ticket_id").alias("ticket_count"),
        F.avg("resolution_hours").alias("avg_resolution_hours"),
        F.avg("csat_score").alias("avg_csat"),
        F.count_if(F.col("priority") == "high").alias("high_priority_tickets"),
        F.count_if(F.col("ticket_type") == "performance_issue").alias("performance_tickets"),
        F.count_if(F.col("ticket_type") == "billing").alias("billing_tickets"),
        F.count_if(F.col("ticket_type") == "feature_request").alias("feature_request_tickets"),
    ]


def _deal_aggregates() -> list[Column]:
    return [
        F.count("deal_id").alias("total_deals"),
        F.count_if(F.col("deal_status") == "lost").alias("lost_deals"),
        F.avg("discount_pct").alias("avg_discount_pct"),
        money_mean(F.col("deal_value")).alias("avg_deal_value"),
        F.avg("_mentions_competitor").alias("competitor_mention_rate"),
    ]


def _recent_rows(usage: DataFrame) -> DataFrame:
    newest = recent_weeks(usage)
    return newest.select("account_id", *(F.col(m).alias(f"_recent_{m}") for m in RECENT_MEANS))


def _support_rows(support: DataFrame) -> DataFrame:
    return support.select("account_id", "ticket_id", "resolution_hours", "csat_score", "priority", "ticket_type")


def _deal_rows(deals: DataFrame) -> DataFrame:
    return deals.select(
        "account_id",
        "deal_id",
        "deal_status",
        "discount_pct",
        "deal_value",
        flag(mentions_competitor(F.col("competitor_mentioned"))).alias("_mentions_competitor"),
    )


def _with_lost_rate(df: DataFrame) -> DataFrame:
    rate = F.col("lost_deals") / clamp_low(F.col("total_deals"), 1)
    return df.withColumn("lost_deal_rate", rate)


def usage_means(usage: DataFrame) -> DataFrame:
    return usage.groupBy("account_id").agg(*_usage_aggregates())


def recent_means(usage: DataFrame) -> DataFrame:
    return _recent_rows(usage).groupBy("account_id").agg(*_recent_aggregates())


def support_summary(support: DataFrame) -> DataFrame:
    return _support_rows(support).groupBy("account_id").agg(*_support_aggregates())


def deal_summary(deals: DataFrame) -> DataFrame:
    return _with_lost_rate(_deal_rows(deals).groupBy("account_id").agg(*_deal_aggregates()))


def churn_labels(cancellations: DataFrame) -> DataFrame:
    """One row per account that ever cancelled."""
    return cancellations.select("account_id").distinct().withColumn(LABEL, F.lit(1))


def account_activity(tables: Tables) -> DataFrame:
    """All per-account measures from all sources: one union, one aggregation, one shuffle.

    Every source only fills its own columns, and the aggregates skip nulls, so adding the rows
    of another source changes nothing. Map tasks see a single source each and reduce it to one
    row per account before the shuffle.
    """
    sources = [
        tables.usage.select("account_id", *USAGE_MEANS),
        _recent_rows(tables.usage),
        _support_rows(tables.support).withColumn("_has_tickets", F.lit(True)),
        _deal_rows(tables.deals).withColumn("_has_deals", F.lit(True)),
        tables.cancellations.select("account_id", F.lit(1).alias(LABEL)),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    grouped = rows.groupBy("account_id").agg(
        *_usage_aggregates(),
        *_recent_aggregates(),
        *_support_aggregates(),
        *_deal_aggregates(),
        F.max("_has_tickets").alias("_has_tickets"),
        F.max("_has_deals").alias("_has_deals"),
        F.max(LABEL).alias(LABEL),
    )
    # A count over no rows is 0 here but missing in a summary of that source alone.
    counted = {c: F.when(F.col("_has_tickets"), F.col(c)) for c in TICKET_COUNTS}
    counted |= {c: F.when(F.col("_has_deals"), F.col(c)) for c in DEAL_COUNTS}
    return _with_lost_rate(grouped.withColumns(counted)).drop("_has_tickets", "_has_deals")


def account_features(tables: Tables, as_of: dt.date = AS_OF, fill: float | None = 0) -> DataFrame:
    """One row per account with its attributes, activity, churn label and age.

    Measures an account has no rows for become ``fill``; ``fill=None`` leaves them null. All
    usage and every cancellation counts, whenever it happened, so the label is not isolated
    from activity after the cancellation.
    """
    joined = tables.accounts.join(account_activity(tables), "account_id", "left")
    table = joined.withColumns(
        {
            LABEL: F.coalesce(LABEL, F.lit(0)),
            "account_age_days": days_until(as_of, F.col("signup_date")),
        }
    ).select("account_id", *CATEGORICAL, "signup_date", *NUMERIC, LABEL)
    return table if fill is None else table.na.fill(fill, NUMERIC)
