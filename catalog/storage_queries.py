"""Reading and writing: bad lines, partitions, metrics, models, outputs, extracts. Each writes real tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import basics, inputs  # noqa: F401  (basics registers the SQL that is shared below)
from catalog.forest_sql import forest_sql
from catalog.model_queries import feature_table
from catalog.registry import SQL, register
from lossledger.operators import forest
from lossledger.operators.features import LABEL
from lossledger.operators.recommend import recommend
from lossledger.operators.rollups import loss_summary, loss_trend, segment_loss
from lossledger.plans import exports
from lossledger.session import shared_folder, stage
from lossledger.sources import sinks
from lossledger.sources import star_schema as star
from lossledger.sources.tables import read_checked

ACCOUNT_COLUMNS = ("account_id", "company_size", "industry", "region", "plan_type", "signup_date", "monthly_revenue")
METRIC_COLUMNS = ("roc_auc", "pr_auc", "accuracy", "recall", "f1", "optimal_threshold", "positive_rate")


@register("s01_quarantine", """
    with lines as (
        select *, case when account_id % 13 = 0 then 'soon' else coalesce(cast(signup_date as varchar), '') end as day,
               case when account_id % 17 = 0 then 'n/a' else cast(monthly_revenue::double as varchar) end as revenue
        from accounts)
    select cast(account_id as varchar) as account_id,
           case when day = 'soon' or revenue = 'n/a' then null else monthly_revenue::double end as monthly_revenue,
           case when day = 'soon' or revenue = 'n/a' then concat_ws(',', account_id, company_size, industry, region, plan_type, day, revenue)
           end as bad_line
    from lines""")
def quarantine(spark, path):
    """Accounts as CSV, some with a day or a number that is none; good rows and set-aside lines of the read."""
    folder = shared_folder(spark, "damaged")
    number = F.col("account_id").cast("long")
    texts = star.accounts(spark, path).select(*(F.col(c).cast("string").alias(c) for c in ACCOUNT_COLUMNS)).withColumns({
        "signup_date": F.when(number % 13 == 0, "soon").otherwise(F.col("signup_date")),
        "monthly_revenue": F.when(number % 17 == 0, "n/a").otherwise(F.col("monthly_revenue").cast("double").cast("string"))})
    texts.write.option("header", True).csv(f"{folder}/accounts.csv")
    good, bad = read_checked(spark, folder, "accounts")
    return good.select("account_id", "monthly_revenue", F.lit(None).cast("string").alias("bad_line")).unionByName(bad.select(
        F.substring_index("line", ",", 1).alias("account_id"), F.lit(None).cast("double").alias("monthly_revenue"),
        F.col("line").alias("bad_line")))


@register("s02_refreshed_month", """
    select period, churn_revenue_lost, lost_deal_value, case when period = (select max(period) from trend) then 2 else 1 end
           * total_revenue_loss as total_revenue_loss from trend""")
def refreshed_month(spark, path):
    """The trend by month folders, of which the last month's alone is written anew."""
    target = f"{shared_folder(spark, 'trend')}/trend"
    trend = stage(inputs.trend(spark, path)).select("period", "churn_revenue_lost", "lost_deal_value", "total_revenue_loss")
    sinks.write_table(trend, target, partition="period")
    last = trend.agg(F.max("period")).first()[0]
    month = sinks.read_output(spark, target, "parquet", partitioned=True).where(F.col("period") == last)
    sinks.refresh_partitions(stage(month.withColumn("total_revenue_loss", 2 * F.col("total_revenue_loss"))), target, "period")
    return sinks.read_output(spark, target, "parquet", partitioned=True)


@register("s03_metrics_file", "select " + ", ".join(
    f"round_even({c} * 10000.0::double, 0) / 10000.0::double as {c}" for c in METRIC_COLUMNS) + " from metrics")
def metrics_file(spark, path):
    root = shared_folder(spark, "metrics")
    sinks.write_metrics(inputs.metrics(spark, path), root)
    return sinks.read_metrics(spark, root).select(*METRIC_COLUMNS)


@register("s04_model_read_back", f"""
    with {forest_sql('true', trees=40)}
    select account_id, {LABEL}, churn_probability from scored join prepared using (account_id)""")
def model_read_back(spark, path):
    """Scores of a fitted model that was saved and loaded."""
    target, table = f"{shared_folder(spark, 'model')}/model", stage(feature_table(spark, path))
    forest.fit(table, trees=40).save(target)
    return forest.score(forest.ForestModel.load(spark, target), table).select("account_id", LABEL, "churn_probability")


@register("s05_segments_read_back", "select * from segments")
def segments_read_back(spark, path):
    """A written CSV table with the types it had."""
    target = f"{shared_folder(spark, 'outputs')}/segments"
    sinks.write_table(inputs.segments(spark, path), target, "csv")
    return sinks.read_output(spark, target, "csv")


@register("s06_outputs_ready", """
    select 'revenue_loss_summary' as name, false as ready_before, count(*) as rows_written, true as ready_after from summary
    union all select 'revenue_loss_trend', false, count(*), true from trend
    union all select 'segment_loss', false, count(*), true from segments
    union all select 'recommendations', false, count(*), true from recommendations""")
def outputs_ready(spark, path):
    """Outputs are ready once they are written to the end, and the metrics with them."""
    root, losses = shared_folder(spark, "outputs"), stage(inputs.ledger(spark, path))
    summary = stage(loss_summary(losses, ordered=False))
    tables = {"revenue_loss_summary": summary, "revenue_loss_trend": loss_trend(losses, ordered=False),
              "segment_loss": segment_loss(losses, star.accounts(spark, path), ordered=False), "recommendations": recommend(summary)}
    sinks.write_metrics(inputs.metrics(spark, path), root)
    before = {name: sinks.outputs_ready(spark, root, [name]) for name in tables}
    written = {name: sinks.write_table(df, sinks.table_path(root, name), partition=sinks.PARTITIONS.get(name)) for name, df in tables.items()}
    return spark.createDataFrame([(name, before[name], written[name], sinks.outputs_ready(spark, root, [name])) for name in tables],
                                 "name string, ready_before boolean, rows_written bigint, ready_after boolean")


def _written_extracts(spark, path):
    """Extracts from outputs that share one stored ledger and one stored score table; counts come from the writes."""
    target, losses = shared_folder(spark, "extracts"), stage(inputs.ledger(spark, path))
    summary, risk = stage(loss_summary(losses, ordered=False)), stage(inputs.risk(spark, path))
    outputs = {
        "account_risk_scores": risk,
        "revenue_loss_summary": summary,
        "revenue_loss_trend": loss_trend(losses, ordered=False),
        "segment_loss": segment_loss(losses, star.accounts(spark, path), ordered=False),
        "model_metrics": inputs.metrics(spark, path),
        "recommendations": recommend(summary),
        "cancellations_classified": inputs.classified_cancellations(spark, path),
        "support_tickets_classified": inputs.classified_tickets(spark, path),
        "sales_notes_classified": inputs.classified_notes_with_account(spark, path),
    }
    return exports.write_extracts(spark, exports.build_extracts(outputs), target), target


@register("s07_written_risk_scores", "select cast(account_id as varchar) as account_id, churn_probability, risk_tier from risk")
def written_risk_scores(spark, path):
    """One of the extracts as a reader of the CSV files sees it."""
    target = f"{shared_folder(spark, 'extracts')}/risk_scores"
    sinks.write_table(exports.views.risk_extract(inputs.risk(spark, path)), target, "csv", null="")
    return spark.read.option("header", True).csv(target).select("account_id", F.col("churn_probability").cast("double"), "risk_tier")


@register("s08_manifest_of_written_extracts")
def manifest_of_written_extracts(spark, path):
    """Rows of each extract, counted while it is written."""
    return _written_extracts(spark, path)[0]


SQL["s08_manifest_of_written_extracts"] = SQL["s08_export_manifest"]
