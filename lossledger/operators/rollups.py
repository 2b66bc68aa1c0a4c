"""Rollups of the loss ledger: by cause, by month, by customer segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossledger.functions.dates import month_of
from lossledger.functions.numbers import round_half_even
from lossledger.operators.ledger import CHURN, LOST_DEAL

SEGMENT = ("plan_type", "region", "industry")


def _measure(value: Column, source: str) -> Column:
    return F.when(F.col("source") == source, value)


def _both_sources() -> list[Column]:
    """Amount and number of events per source, from ledger rows, in one pass."""
    amount, record = F.col("amount"), F.col("record_id")
    return [
        F.sum(_measure(amount, CHURN)).alias("churn_revenue_lost"),
        F.count(_measure(record, CHURN)).alias("churn_events"),
        F.sum(_measure(amount, LOST_DEAL)).alias("lost_deal_value"),
        F.count(_measure(record, LOST_DEAL)).alias("lost_deal_events"),
    ]


def _finish(rolled: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    churn = F.coalesce(F.col("churn_revenue_lost").cast("double"), F.lit(0.0))
    deals = F.coalesce(F.col("lost_deal_value").cast("double"), F.lit(0.0))
    return rolled.select(
        *keys,
        churn.alias("churn_revenue_lost"),
        F.col("churn_events").cast("bigint").alias("churn_events"),
        deals.alias("lost_deal_value"),
        F.col("lost_deal_events").cast("bigint").alias("lost_deal_events"),
        (churn + deals).alias("total_revenue_loss"),
    )


def percent_of_total(df: DataFrame, value: str, name: str) -> DataFrame:
    """Share of the grand total in percent, two decimals; 0 when there is no loss at all.

    Meant for rolled-up tables: their row count is bounded by the rule set, so the one
    partition this window needs is small whatever the size of the data underneath.
    """
    total = F.sum(value).over(Window.partitionBy())
    share = F.when(total > 0, round_half_even(F.col(value) / total * 100)).otherwise(0.0)
    return df.withColumn(name, share)


def loss_by_cause(ledger: DataFrame) -> DataFrame:
    """Records and rounded loss per (category, subcategory, source)."""
    return ledger.groupBy("category", "subcategory", "source").agg(
        F.count("record_id").alias("source_records"),
        F.coalesce(round_half_even(F.sum("amount").cast("double")), F.lit(0.0)).alias("lost_revenue"),
    )


def loss_summary(ledger: DataFrame, *, ordered: bool = True) -> DataFrame:
    """Loss per cause and source with its share of the total, largest first.

    Where the rows are only summed or joined further, ``ordered=False`` spares the global sort.
    """
    shared = percent_of_total(loss_by_cause(ledger), "lost_revenue", "pct_of_total_loss")
    return shared.orderBy(F.desc("lost_revenue"), "category", "subcategory", "source") if ordered else shared


def loss_trend(events: DataFrame, *, ordered: bool = True) -> DataFrame:
    """Both kinds of loss per month, oldest first; undated losses form a row of their own.

    ``ordered=False`` as in :func:`loss_summary`.
    """
    monthly = events.groupBy(month_of(F.col("event_date")).alias("period")).agg(*_both_sources())
    trend = _finish(monthly, ["period"])
    return trend.orderBy(F.asc_nulls_last("period")) if ordered else trend


SOURCE_COLUMNS = {CHURN: ("churn_revenue_lost", "churn_events"), LOST_DEAL: ("lost_deal_value", "lost_deal_events")}


def source_trend(events: DataFrame, source: str) -> DataFrame:
    """Loss of one source per month. The filter reaches the ledger's parts, so the other source is never read."""
    return loss_trend(events.where(F.col("source") == source), ordered=False).select("period", *SOURCE_COLUMNS[source])


def source_segments(events: DataFrame, accounts: DataFrame, source: str) -> DataFrame:
    """Loss of one source per segment; the other source is never read."""
    rolled = segment_loss(events.where(F.col("source") == source), accounts, ordered=False)
    return rolled.select(*SEGMENT, *SOURCE_COLUMNS[source])


def segment_loss(events: DataFrame, accounts: DataFrame, *, ordered: bool = True) -> DataFrame:
    """Both kinds of loss per (plan, region, industry), largest first.

    Losses are summed per account before the accounts are joined, and repeated account rows are
    collapsed to a count, so neither a busy account nor a repeated one becomes a hot task.
    A repeated account counts its losses once per row, as a plain join would. ``ordered=False`` as in
    :func:`loss_summary`.
    """
    per_account = events.groupBy("account_id").agg(*_both_sources())
    segments = accounts.groupBy("account_id", *SEGMENT).agg(F.count(F.lit(1)).alias("_copies"))
    joined = per_account.join(segments, "account_id", "left").withColumn(
        "_copies", F.coalesce("_copies", F.lit(1)).cast("decimal(10,0)")
    )
    measures = ("churn_revenue_lost", "churn_events", "lost_deal_value", "lost_deal_events")
    rolled = joined.groupBy(*SEGMENT).agg(
        *(F.sum(F.col(m).cast("decimal(28,4)") * F.col("_copies")).alias(m) for m in measures)
    )
    segments = _finish(rolled, SEGMENT)
    return segments.orderBy(F.desc("total_revenue_loss"), *SEGMENT) if ordered else segments


def reconcile(summary: DataFrame, trend: DataFrame, segments: DataFrame) -> DataFrame:
    """Totals of the three rollups per source, side by side.

    The summary is rounded to cents per cause, so totals may differ by less than a cent per row.
    """
    def totals(df: DataFrame, view: str) -> DataFrame:
        return df.select(
            F.lit(view).alias("view"),
            F.explode(
                F.array(
                    F.struct(F.lit(CHURN).alias("source"), F.col("churn_revenue_lost").alias("loss")),
                    F.struct(F.lit(LOST_DEAL).alias("source"), F.col("lost_deal_value").alias("loss")),
                )
            ).alias("entry"),
        ).select("view", "entry.source", "entry.loss")

    causes = summary.select(F.lit("summary").alias("view"), "source", F.col("lost_revenue").alias("loss"))
    every = causes.unionByName(totals(trend, "trend")).unionByName(totals(segments, "segment"))

    def of(view: str) -> Column:
        loss = F.when(F.col("view") == view, F.col("loss")).cast("decimal(28,4)")
        return F.coalesce(F.sum(loss), F.lit(0)).cast("double").alias(f"{view}_total")

    compared = every.groupBy("source").agg(of("summary"), of("trend"), of("segment"))
    gap = F.greatest(
        F.abs(F.col("summary_total") - F.col("trend_total")), F.abs(F.col("trend_total") - F.col("segment_total"))
    )
    return compared.withColumn("agrees", gap < 0.5)
