"""Ranking quality of a score against a 0/1 label, exact and distributed.

Works on any (label, score) table. Rows collapse to one per distinct score first; tied scores
are one step of the curve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.functions.numbers import ratio
from lossledger.operators.cumulative import running_totals
from lossledger.session import stage

NO_THRESHOLD = 0.5

# Metrics in reporting order.
METRICS = ("roc_auc", "pr_auc", "accuracy", "recall", "f1", "optimal_threshold", "positive_rate")


def score_counts(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return (
        scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("positives"),
            F.count_if(F.col(label) != 1).alias("negatives"),
        )
    )


def _f1(tp: Column, fp: Column, positives: Column) -> Column:
    return ratio(2.0 * tp, tp + fp + positives, 0.0)


def pr_curve(scored: DataFrame, label: str, score: str, buckets: int | None = None) -> DataFrame:
    """Precision, recall and F1 when everything at or above a score is called positive.

    One row per distinct score; ``tp`` and ``fp`` are counts at or above it. The collapsed
    counts are stored, so the scored table is evaluated once however often the curve reads them.
    """
    counts = stage(score_counts(scored, label, score))
    curve = running_totals(
        counts, "score", {"tp": "positives", "fp": "negatives"}, descending=True, buckets=buckets
    )
    whole = counts.agg(F.sum("positives")).scalar()
    tp, fp = F.col("tp"), F.col("fp")
    return (
        curve.withColumn("_positives", whole)
        .withColumns(
            {
                "precision": tp / (tp + fp),
                # With no positives at all nothing can be missed.
                "recall": ratio(tp, F.col("_positives"), 1.0),
                "f1": _f1(tp, fp, F.col("_positives")),
            }
        )
        .drop("_positives")
    )


def ranking_metrics(curve: DataFrame) -> DataFrame:
    """One row: ROC-AUC, average precision, the F1-best threshold and quality at it.

    * ROC-AUC counts, for each negative, the positives scored above it plus half of those tied
      with it. The counts are whole numbers, so the sum is exact in any order.
    * Average precision weighs the precision at each score by the recall gained there; no
      interpolation.
    * The threshold is the score with the highest F1, the lowest such score on a tie, and 0.5
      where there is no score at all.
    """
    p, n, tp, fp = (F.col(c) for c in ("positives", "negatives", "tp", "fp"))
    wins = (2 * tp - p).cast("decimal(19,0)") * n.cast("decimal(19,0)")
    gained = (p.cast("double") * tp / (tp + fp)).cast("decimal(30,12)")
    at_best = F.max_by(F.struct("score", "tp", "fp", "f1"), F.struct(F.col("f1"), -F.col("score")))
    sums = curve.agg(
        F.sum(wins).cast("double").alias("wins"),
        F.sum(gained).cast("double").alias("gained"),
        F.sum("positives").alias("P"),
        F.sum("negatives").alias("N"),
        at_best.alias("best"),
    )
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    return sums.select(
        ratio(F.col("wins"), 2.0 * P * N).alias("roc_auc"),
        ratio(F.col("gained"), P, 0.0).alias("pr_auc"),
        ratio(F.col("best.tp") + F.col("N") - F.col("best.fp"), P + N).alias("accuracy"),
        ratio(F.col("best.tp"), P, 0.0).alias("recall"),
        F.coalesce("best.f1", F.lit(0.0)).alias("f1"),
        F.coalesce("best.score", F.lit(NO_THRESHOLD)).alias("optimal_threshold"),
        ratio(P, P + N).alias("positive_rate"),
    )


def confusion_at(scored: DataFrame, label: str, score: str, threshold: float | Column) -> DataFrame:
    """Accuracy, recall and F1 of ``score >= threshold``; one pass over the rows."""
    at = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    actual, called = F.col(label) == 1, F.col(score) >= at
    counts = scored.agg(
        F.count_if(called & actual).alias("tp"),
        F.count_if(called & ~actual).alias("fp"),
        F.count_if(~called & actual).alias("fn"),
        F.count_if(~called & ~actual).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fn, 0.0).alias("recall"),
        _f1(tp, fp, tp + fn).alias("f1"),
    )
