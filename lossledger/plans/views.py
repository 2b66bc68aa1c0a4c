"""Reporting views: what each panel and card shows, as functions of tables and parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.functions.numbers import as_money, exact_mean
from lossledger.functions.text import lookup_label, segment_label
from lossledger.operators.evaluate import METRICS
from lossledger.operators.ledger import CHURN, LOST_DEAL
from lossledger.operators.rollups import SEGMENT
from lossledger.operators.scoring import by_risk
from lossledger.operators.taxonomy import RULES, Rule, classify
from lossledger.settings import RISK_THRESHOLD

TREND_MEASURES = ["churn_revenue_lost", "lost_deal_value", "total_revenue_loss"]
QUALITY = METRICS[:5]


def _total(value: Column) -> Column:
    """Exact sum, 0 for no rows."""
    return F.coalesce(F.sum(as_money(value)).cast("double"), F.lit(0.0))


def choose(scores: DataFrame, plans: Sequence[str] | None = None, regions: Sequence[str] | None = None) -> DataFrame:
    """Accounts in the chosen plans and regions; ``None`` means no choice was made."""
    if plans is not None:
        scores = scores.where(F.col("plan_type").isin(list(plans)))
    if regions is not None:
        scores = scores.where(F.col("region").isin(list(regions)))
    return scores


def filter_options(scores: DataFrame) -> DataFrame:
    """Values on offer per filter, sorted; one pass for both filters."""
    pairs = F.array(
        *(F.struct(F.lit(c).alias("filter"), F.col(c).alias("choice")) for c in ("plan_type", "region"))
    )
    return (
        scores.select(F.explode(pairs).alias("p"))
        .select("p.filter", "p.choice")
        .where(F.col("choice").isNotNull())
        .distinct()
        .orderBy("filter", "choice")
    )


def at_risk(scores: DataFrame, threshold: float = RISK_THRESHOLD) -> DataFrame:
    return scores.where(F.col("churn_probability") >= threshold)


def risk_kpis(scores: DataFrame, threshold: float = RISK_THRESHOLD) -> DataFrame:
    """Revenue at risk, accounts at or above the threshold and mean probability; one pass."""
    return scores.agg(
        _total(F.col("estimated_monthly_revenue_at_risk")).alias("total_revenue_at_risk"),
        F.count_if(F.col("churn_probability") >= threshold).alias("critical_accounts"),
        exact_mean(F.col("churn_probability"), 12).alias("mean_risk"),
    )


def loss_of(source: str, value: str = "lost_revenue") -> Column:
    return _total(F.when(F.col("source") == source, F.col(value)))


def source_totals(summary: DataFrame) -> DataFrame:
    """Churn loss and lost-deal loss over the whole summary, whatever else is filtered."""
    return summary.agg(loss_of(CHURN).alias("modeled_churn_loss"), loss_of(LOST_DEAL).alias("modeled_lost_deal_value"))


def kpi_snapshot(scores: DataFrame, summary: DataFrame, threshold: float = RISK_THRESHOLD) -> DataFrame:
    """Headline figures in one row: both inputs feed one aggregation, so nothing is joined."""
    accounts = scores.select("estimated_monthly_revenue_at_risk", "churn_probability")
    losses = summary.select("source", "lost_revenue")
    return accounts.unionByName(losses, allowMissingColumns=True).agg(
        _total(F.col("estimated_monthly_revenue_at_risk")).alias("monthly_revenue_at_risk"),
        F.count_if(F.col("churn_probability") >= threshold).alias("high_risk_accounts_at_0_50"),
        loss_of(CHURN).alias("modeled_churn_loss"),
        loss_of(LOST_DEAL).alias("modeled_lost_deal_value"),
        exact_mean(F.col("churn_probability"), 12).alias("average_churn_probability"),
        F.lit(float(threshold)).alias("default_risk_threshold"),
    )


def top_at_risk(
    scores: DataFrame,
    threshold: float = RISK_THRESHOLD,
    plans: Sequence[str] | None = None,
    regions: Sequence[str] | None = None,
    n: int = 50,
) -> DataFrame:
    """The ``n`` accounts with most revenue at risk among those chosen and above the threshold."""
    chosen = at_risk(choose(scores, plans, regions), threshold)
    return by_risk(chosen).limit(n).select(
        "account_id",
        "plan_type",
        "region",
        "industry",
        "churn_probability",
        "risk_tier",
        "monthly_revenue",
        "estimated_monthly_revenue_at_risk",
    )


def with_segment(segments: DataFrame) -> DataFrame:
    return segments.withColumn("segment", segment_label(*(F.col(c) for c in SEGMENT)))


def top_segments(segments: DataFrame, n: int = 25) -> DataFrame:
    return with_segment(segments.orderBy(F.desc("total_revenue_loss"), *SEGMENT).limit(n))


def segment_extract(segments: DataFrame) -> DataFrame:
    return with_segment(segments).orderBy(F.desc("total_revenue_loss"), *SEGMENT)


def trend_long(trend: DataFrame) -> DataFrame:
    """The trend with one row per month and measure, and the measure's display name."""
    long = trend.unpivot(["period"], TREND_MEASURES, "metric", "value")
    return long.withColumn("metric_label", lookup_label(F.col("metric")))


def breakdown(summary: DataFrame) -> DataFrame:
    """The summary regrouped by its keys; rows without a cause are left out."""
    return (
        summary.where(F.col("category").isNotNull() & F.col("subcategory").isNotNull())
        .groupBy("category", "subcategory", "source")
        .agg(
            F.sum("source_records").alias("source_records"),
            _total(F.col("lost_revenue")).alias("lost_revenue"),
            _total(F.col("pct_of_total_loss")).alias("pct_of_total_loss"),
        )
        .orderBy(F.desc("lost_revenue"), "category", "subcategory", "source")
    )


def loss_chart(summary: DataFrame) -> DataFrame:
    """Loss per category and source, largest first."""
    rolled = summary.where(F.col("category").isNotNull()).groupBy("category", "source").agg(_total(F.col("lost_revenue")).alias("lost_revenue"))
    return rolled.orderBy(F.desc("lost_revenue"), "category", "source")


def metrics_long(metrics: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """One row per metric in a fixed order; a metric that is missing shows as 0."""
    known = set(metrics.columns)
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("metric"),
            F.upper(F.lit(name)).alias("metric_label"),
            (F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in known else F.lit(0.0)).alias("metric_value"),
        )
        for i, name in enumerate(names)
    ]
    long = metrics.select(F.explode(F.array(*rows)).alias("m"))
    return long.orderBy("m.position").select("m.metric", "m.metric_label", "m.metric_value")


def quality_row(metrics: DataFrame) -> DataFrame:
    known = set(metrics.columns)
    return metrics.select(
        *((F.coalesce(F.col(m).cast("double"), F.lit(0.0)) if m in known else F.lit(0.0)).alias(m) for m in QUALITY)
    )


def risk_extract(scores: DataFrame, threshold: float = RISK_THRESHOLD) -> DataFrame:
    return by_risk(scores.withColumn("risk_threshold_default", F.lit(float(threshold))))


# Evidence view -> (day it is ordered by, id that orders one day, columns shown).
EVIDENCE: Mapping[str, tuple[str, str, tuple[str, ...]]] = {
    "cancellations": (
        "cancellation_date",
        "cancellation_id",
        ("account_id", "cancellation_date", "churned_revenue", "category", "subcategory", "cancellation_reason_text"),
    ),
    "support_tickets": (
        "created_date",
        "ticket_id",
        (
            "account_id",
            "created_date",
            "ticket_type",
            "priority",
            "resolution_hours",
            "category",
            "subcategory",
            "ticket_summary",
        ),
    ),
    "sales_notes": (
        "note_date",
        "note_id",
        ("deal_id", "account_id", "note_date", "category", "subcategory", "note_text"),
    ),
}


def newest_first(records: DataFrame, kind: str) -> DataFrame:
    """The id breaks ties of one day, which also lets the range sort split a day that holds very
    many records."""
    day, record, _ = EVIDENCE[kind]
    return records.orderBy(F.col(day).desc_nulls_last(), record)


def evidence(classified: DataFrame, kind: str) -> DataFrame:
    """Classified records of one kind, newest first."""
    return newest_first(classified, kind).select(*EVIDENCE[kind][2])


def evidence_from_text(records: DataFrame, kind: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """As ``evidence``, for records that are not classified yet.

    They are sorted first: a global sort reads its input twice, once to find the range bounds,
    and the classification should not be part of that.
    """
    shown = EVIDENCE[kind][2]
    return classify(newest_first(records, kind), shown[-1], rules).select(*shown)
