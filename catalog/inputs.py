"""Operator inputs built from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lossledger.operators.attribution import attribute_deals, notes_of
from lossledger.operators.evaluate import pr_curve, ranking_metrics
from lossledger.operators.ledger import loss_events, loss_ledger
from lossledger.operators.profile import with_churned
from lossledger.operators.rollups import loss_summary, loss_trend, segment_loss
from lossledger.operators.scoring import rule_churn_propensity, score_table
from lossledger.operators.taxonomy import classify
from lossledger.sources import star_schema as star


def classified_notes(spark: SparkSession, path: str) -> DataFrame:
    return classify(star.sales_notes(spark, path), "note_text")


def classified_notes_with_account(spark: SparkSession, path: str) -> DataFrame:
    return classify(star.sales_notes_with_account(spark, path), "note_text")


def classified_tickets(spark: SparkSession, path: str) -> DataFrame:
    return classify(star.support_tickets(spark, path), "ticket_summary")


def classified_cancellations(spark: SparkSession, path: str) -> DataFrame:
    return classify(star.cancellations(spark, path), "cancellation_reason_text")


def attributed(spark: SparkSession, path: str) -> DataFrame:
    return attribute_deals(star.deals(spark, path), classified_notes(spark, path))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Only notes of lost deals are classified: no other note can show up in a loss."""
    notes = notes_of(star.sales_notes(spark, path), star.lost_deal_ids(spark, path))
    lost = attribute_deals(star.deals(spark, path, lost_only=True), classify(notes, "note_text"))
    return loss_ledger(lost, classified_cancellations(spark, path))


def events(spark: SparkSession, path: str) -> DataFrame:
    return loss_events(star.deals(spark, path, lost_only=True), star.cancellations(spark, path))


def summary(spark: SparkSession, path: str, *, ordered: bool = False) -> DataFrame:
    return loss_summary(ledger(spark, path), ordered=ordered)


def trend(spark: SparkSession, path: str, *, ordered: bool = False) -> DataFrame:
    return loss_trend(events(spark, path), ordered=ordered)


def segments(spark: SparkSession, path: str, *, ordered: bool = False) -> DataFrame:
    return segment_loss(events(spark, path), star.accounts(spark, path), ordered=ordered)


def propensity(spark: SparkSession, path: str) -> DataFrame:
    """Accounts with their rule score."""
    return rule_churn_propensity(star.accounts(spark, path), star.product_usage(spark, path))


def risk(spark: SparkSession, path: str, *, ordered: bool = False) -> DataFrame:
    return score_table(propensity(spark, path), ordered=ordered)


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """Accounts with rule score and whether they cancelled."""
    return with_churned(propensity(spark, path), star.cancellations(spark, path))


def curve(spark: SparkSession, path: str) -> DataFrame:
    return pr_curve(labelled(spark, path), "churned", "churn_probability")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    return ranking_metrics(curve(spark, path))
