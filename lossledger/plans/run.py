"""The whole batch: from business tables to scores, rollups and recommendations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lossledger.functions.numbers import money_sum
from lossledger.operators.attribution import attribute_deals
from lossledger.operators.features import account_features
from lossledger.operators.forest import score, train
from lossledger.operators.ledger import loss_events, loss_ledger
from lossledger.operators.model import TREES
from lossledger.operators.recommend import recommend
from lossledger.operators.rollups import loss_summary, loss_trend, segment_loss
from lossledger.operators.scoring import SCORE_INPUTS, score_table
from lossledger.operators.taxonomy import RULES, Rule, classify
from lossledger.session import apply_settings, stage
from lossledger.settings import AS_OF, SEED
from lossledger.sources import sinks
from lossledger.sources.tables import Tables, load_checked, load_tables


def run(
    spark: SparkSession,
    in_path: str,
    out_path: str,
    as_of: dt.date = AS_OF,
    *,
    in_fmt: str = "csv",
    multiline: bool = False,
    out_fmt: str = "parquet",
    seed: int = SEED,
    trees: int = TREES,
    rules: tuple[Rule, ...] = RULES,
    quarantine: bool = False,
) -> dict[str, object]:
    """Read the tables under ``in_path`` and write every output under ``out_path``.

    A CSV line that does not fit its schema ends the run; with ``quarantine`` such lines are written to a
    table of their own, and their number is part of the result.
    """
    if not quarantine:
        tables = load_tables(apply_settings(spark), in_path, in_fmt, multiline)
        return run_tables(spark, tables, out_path, as_of, out_fmt=out_fmt, seed=seed, trees=trees, rules=rules)
    if in_fmt != "csv":
        raise ValueError("only CSV tables have lines that do not fit their schema")
    tables, bad = load_checked(apply_settings(spark), in_path, multiline)
    set_aside = sinks.write_table(bad, sinks.table_path(out_path, "quarantine"), out_fmt)
    result = run_tables(spark, tables, out_path, as_of, out_fmt=out_fmt, seed=seed, trees=trees, rules=rules)
    return result | {"quarantined_rows": set_aside}


def run_tables(
    spark: SparkSession,
    tables: Tables,
    out_path: str,
    as_of: dt.date = AS_OF,
    *,
    out_fmt: str = "parquet",
    seed: int = SEED,
    trees: int = TREES,
    rules: tuple[Rule, ...] = RULES,
) -> dict[str, object]:
    """Write every output for the given tables and summarise the run.

    A table that later steps share is written once and read back, so its lineage ends in
    storage: no step repeats the text classification or the joins of an earlier one, and a lost
    executor costs a re-read.
    """
    rows: dict[str, int] = {}

    def write(name: str, df: DataFrame) -> None:
        rows[name] = sinks.write_table(df, sinks.table_path(out_path, name), out_fmt, partition=sinks.PARTITIONS.get(name))

    def store(name: str, df: DataFrame) -> DataFrame:
        path = sinks.table_path(out_path, name)
        rows[name] = sinks.write_table(df, path, out_fmt)
        return sinks.read_output(spark, path, out_fmt, df.schema)

    notes = store("sales_notes_classified", classify(tables.notes, "note_text", rules))
    cancellations = store(
        "cancellations_classified", classify(tables.cancellations, "cancellation_reason_text", rules)
    )
    store("support_tickets_classified", classify(tables.support, "ticket_summary", rules))
    deals = store("deals_enriched", attribute_deals(tables.deals, notes))

    # Rollups need no model, so they come before the training.
    summary = store("revenue_loss_summary", loss_summary(loss_ledger(deals, cancellations)))
    events = loss_events(deals, cancellations)
    write("revenue_loss_trend", loss_trend(events))
    write("segment_loss", segment_loss(events, tables.accounts))
    write("recommendations", recommend(summary))

    features = store("account_features", account_features(tables, as_of))
    trained = train(features, seed=seed, trees=trees)
    # Stored before it is sorted: a global sort reads its input twice, and the forest is costly.
    scored = stage(score(trained.model, features).select(*SCORE_INPUTS, "churn_probability"))
    write("account_risk_scores", score_table(scored))
    trained.model.save(f"{out_path}/{sinks.MODEL}")
    sinks.write_metrics(trained.metrics, out_path)

    return {
        "metrics": _only_row(sinks.read_metrics(spark, out_path)),
        "processed_dir": f"{out_path}/{sinks.PROCESSED}",
        "artifacts_dir": f"{out_path}/{sinks.ARTIFACTS}",
        "risk_rows": rows["account_risk_scores"],
        "revenue_loss_total": _only_row(total_loss(summary))["revenue_loss_total"],
    }


def total_loss(summary: DataFrame) -> DataFrame:
    return summary.agg(F.coalesce(money_sum(F.col("lost_revenue")), F.lit(0.0)).alias("revenue_loss_total"))


def _only_row(df: DataFrame) -> dict[str, object]:
    row: Row = df.first()
    return row.asDict()
