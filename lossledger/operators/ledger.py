"""One long table of losses, fed by cancellations and lost deals.

The rollups read this table, so combining both sources is a union under one aggregation rather
than an outer join of two aggregates: null group keys stay groups and no side is null-extended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.functions.numbers import as_money
from lossledger.operators.attribution import effective_value

CHURN = "churn"
LOST_DEAL = "lost_deal"


def lost_deals(deals: DataFrame) -> DataFrame:
    return deals.where(F.col("deal_status") == "lost")


def _churn_rows(cancellations: DataFrame, *cause: str) -> DataFrame:
    return cancellations.select(
        F.lit(CHURN).alias("source"),
        F.col("cancellation_id").cast("string").alias("record_id"),
        "account_id",
        F.col("cancellation_date").alias("event_date"),
        *cause,
        as_money(F.col("churned_revenue")).alias("amount"),
    )


def _deal_rows(deals: DataFrame, amount, *cause) -> DataFrame:
    return lost_deals(deals).select(
        F.lit(LOST_DEAL).alias("source"),
        F.col("deal_id").cast("string").alias("record_id"),
        "account_id",
        F.col("close_date").alias("event_date"),
        *cause,
        as_money(amount).alias("amount"),
    )


def loss_events(deals: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Losses without their cause: all a trend or a segment view needs, and no text is read."""
    amount = effective_value(F.col("deal_value"), F.col("discount_pct"))
    return _churn_rows(cancellations).unionByName(_deal_rows(deals, amount))


def loss_ledger(attributed_deals: DataFrame, classified_cancellations: DataFrame) -> DataFrame:
    """Losses with their cause."""
    churn = _churn_rows(classified_cancellations, "category", "subcategory")
    deals = _deal_rows(
        attributed_deals,
        F.col("effective_deal_value"),
        F.col("deal_loss_category").alias("category"),
        F.col("deal_loss_subcategory").alias("subcategory"),
    )
    return churn.unionByName(deals)
