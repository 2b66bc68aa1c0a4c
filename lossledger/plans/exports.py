"""Extracts for a reporting tool, and the manifest that lists them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.operators.profile import shape, union_all
from lossledger.plans import views
from lossledger.sources.sinks import load_outputs, write_table


def build_extracts(outputs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Ten extracts from the outputs of a run."""
    summary, scores = outputs["revenue_loss_summary"], outputs["account_risk_scores"]
    return {
        "risk_scores": views.risk_extract(scores),
        "revenue_loss_breakdown": views.breakdown(summary),
        "revenue_loss_trend_long": views.trend_long(outputs["revenue_loss_trend"]),
        "segment_loss": views.segment_extract(outputs["segment_loss"]),
        "model_metrics": views.metrics_long(outputs["model_metrics"]),
        "kpi_snapshot": views.kpi_snapshot(scores, summary),
        "recommendations": outputs["recommendations"],
        "evidence_cancellations": outputs["cancellations_classified"],
        "evidence_support_tickets": outputs["support_tickets_classified"],
        "evidence_sales_notes": outputs["sales_notes_classified"],
    }


def count_manifest(extracts: Mapping[str, DataFrame]) -> DataFrame:
    """(file_name, row_count, column_count) of extracts that were not written yet."""
    return union_all([shape(df, name).withColumnRenamed("table_name", "file_name") for name, df in extracts.items()])


def export_views(
    spark: SparkSession, root: str, target: str, fmt: str = "csv", *, source_fmt: str = "parquet"
) -> DataFrame:
    """Write every extract of the run under ``root`` to ``target`` and return the manifest.

    ``source_fmt`` is the run's output format. Row counts are taken while writing; no extract is computed twice.
    """
    manifest = write_extracts(spark, build_extracts(load_outputs(spark, root, fmt=source_fmt)), target, fmt).withColumns(
        {"generated_at_utc": F.lit(dt.datetime.now(dt.timezone.utc)), "source_dir": F.lit(root), "export_dir": F.lit(target)}
    )
    manifest.write.mode("overwrite").json(f"{target}/manifest")
    return manifest


def write_extracts(spark: SparkSession, extracts: Mapping[str, DataFrame], target: str, fmt: str = "csv") -> DataFrame:
    """Write extracts and return (file_name, row_count, column_count), counted while writing."""
    listed = [(name, write_table(df, f"{target}/{name}", fmt, null=""), len(df.columns)) for name, df in extracts.items()]
    return spark.createDataFrame(listed, "file_name string, row_count bigint, column_count int")
