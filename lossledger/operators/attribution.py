"""Attribution of deals to a loss cause: best note, fallback cause, discounted value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossledger.operators.taxonomy import NO_CATEGORY, NO_SUBCATEGORY

# Fallback causes and the confidence given to a deal without notes.
DISCOUNT_CAUSE = ("Commercial", "pricing_concerns")
COMPETITOR_CAUSE = ("Competitive", "competitor_switch")
HEAVY_DISCOUNT = 20
NO_NOTE_CONFIDENCE = 0.3
NO_COMPETITOR = "None"


def mentions_competitor(competitor: Column) -> Column:
    """A named competitor; null and the literal ``None`` both mean nobody was named."""
    return competitor.isNotNull() & (competitor != NO_COMPETITOR)


def effective_value(deal_value: Column, discount_pct: Column) -> Column:
    return deal_value * (1 - discount_pct / 100.0)


def best_note_per_deal(notes: DataFrame) -> DataFrame:
    """The most confident classified note of each deal.

    Ties go to the earlier note, then the smaller id, then the cause's name, so the outcome does
    not depend on row order. Filtering on ``row_number`` lets Spark keep one row per deal in each
    map task before the shuffle, which also bounds a deal with very many notes.
    """
    order = Window.partitionBy("deal_id").orderBy(
        F.col("confidence").desc(),
        F.col("note_date").asc_nulls_last(),
        F.col("note_id").asc_nulls_last(),
        F.col("category"),
        F.col("subcategory"),
    )
    return (
        notes.select("deal_id", "note_id", "note_date", "category", "subcategory", "confidence")
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") == 1)
        .select(
            "deal_id",
            F.col("category").alias("deal_loss_category"),
            F.col("subcategory").alias("deal_loss_subcategory"),
            F.col("confidence").alias("deal_loss_confidence"),
        )
    )


def fill_cause(deals: DataFrame) -> DataFrame:
    """Causes for deals that no note explains: heavy discount first, then a named competitor."""
    heavy = F.col("discount_pct") >= HEAVY_DISCOUNT
    rival = mentions_competitor(F.col("competitor_mentioned"))

    def fallback(position: int, default: str) -> Column:
        return F.when(heavy, DISCOUNT_CAUSE[position]).when(rival, COMPETITOR_CAUSE[position]).otherwise(default)

    return deals.withColumns(
        {
            "deal_loss_category": F.coalesce("deal_loss_category", fallback(0, NO_CATEGORY)),
            "deal_loss_subcategory": F.coalesce("deal_loss_subcategory", fallback(1, NO_SUBCATEGORY)),
            "deal_loss_confidence": F.coalesce("deal_loss_confidence", F.lit(NO_NOTE_CONFIDENCE)),
        }
    )


def notes_of(notes: DataFrame, deals: DataFrame) -> DataFrame:
    """The notes of the given deals (a table with ``deal_id``). Taken before the notes are classified, it
    spares the work on all others."""
    return notes.join(deals.select("deal_id"), "deal_id", "left_semi")


def attribute_deals(deals: DataFrame, classified_notes: DataFrame) -> DataFrame:
    """Every deal with its loss cause, the cause's confidence and the discounted value."""
    noted = deals.join(best_note_per_deal(classified_notes), "deal_id", "left")
    return fill_cause(noted).withColumn(
        "effective_deal_value", effective_value(F.col("deal_value"), F.col("discount_pct"))
    )
