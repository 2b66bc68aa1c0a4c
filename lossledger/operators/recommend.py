"""Ranked actions for the categories that lose most."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossledger.operators.taxonomy import NO_CATEGORY

# Recommended action per category.
PLAYBOOK: dict[str, str] = {
    "Commercial": "Offer value-based packaging and proactive renewal outreach for price-sensitive segments.",
    "Product": "Prioritize roadmap fixes for templates/performance gaps and publish release communication to affected accounts.",
    "Operational": "Reduce support response time with SLA escalation for high-priority tickets and onboarding checkpoints.",
    "Competitive": "Strengthen competitive battlecards and focus sales demos on collaboration + AI differentiation.",
    "Adoption / Value Realization": "Launch customer success activation program for low-usage accounts within first 30 days.",
    "Uncategorized": "Perform manual review of notes to enrich taxonomy and improve root-cause tagging quality.",
}


def loss_by_category(summary: DataFrame) -> DataFrame:
    """Loss and records per category; rows without a category are left out."""
    return (
        summary.where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            F.sum(F.col("lost_revenue").cast("decimal(28,4)")).cast("double").alias("total_lost_revenue"),
            F.sum("source_records").alias("source_records"),
        )
    )


def with_action(df: DataFrame, playbook: Mapping[str, str] = PLAYBOOK) -> DataFrame:
    """The playbook is a handful of literals, so the lookup is a map in the projection."""
    pairs = [F.lit(part) for item in playbook.items() for part in item]
    action = F.try_element_at(F.create_map(*pairs), F.col("category"))
    return df.withColumn("recommended_action", F.coalesce(action, F.lit(playbook[NO_CATEGORY])))


def recommend(summary: DataFrame, top_n: int = 5, playbook: Mapping[str, str] = PLAYBOOK) -> DataFrame:
    """The ``top_n`` categories by loss, numbered from 1, each with its action."""
    top = loss_by_category(summary).orderBy(F.desc("total_lost_revenue"), "category").limit(top_n)
    # At most top_n rows reach this window.
    priority = F.row_number().over(Window.orderBy(F.desc("total_lost_revenue"), F.asc("category")))
    return (
        with_action(top, playbook)
        .withColumn("priority", priority)
        .select("priority", "category", "total_lost_revenue", "source_records", "recommended_action")
    )
