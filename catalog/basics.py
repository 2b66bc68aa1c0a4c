"""Sources, projections, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs
from catalog.registry import register
from catalog.sql_views import money
from lossledger.functions.numbers import flag, money_sum
from lossledger.functions.text import lookup_label
from lossledger.operators import attribution, features, ledger, profile, recommend, rollups
from lossledger.operators.lookups import lookup_join
from lossledger.plans import exports, views
from lossledger.session import stage
from lossledger.sources import star_schema as star

# ---- sources and sinks ------------------------------------------------------------------------


@register("s08_export_manifest", """
    select 'risk_scores' as file_name, count(*) as row_count, 9 as column_count from risk
    union all select 'revenue_loss_breakdown', count(*), 6 from summary
    union all select 'revenue_loss_trend_long', 3 * count(*), 4 from trend
    union all select 'segment_loss', count(*), 9 from segments
    union all select 'model_metrics', 7, 3
    union all select 'kpi_snapshot', 1, 6
    union all select 'recommendations', count(*), 5 from recommendations
    union all select 'evidence_cancellations', count(*), 11 from cancellations
    union all select 'evidence_support_tickets', count(*), 12 from support_tickets
    union all select 'evidence_sales_notes', count(*), 9 from sales_notes""")
def export_manifest(spark, path):
    """Every text is classified for its own extract; the losses are classified once, for a stored summary."""
    summary, risk = stage(inputs.summary(spark, path, ordered=True)), stage(inputs.risk(spark, path, ordered=True))
    outputs = {
        "account_risk_scores": risk,
        "revenue_loss_summary": summary,
        "revenue_loss_trend": inputs.trend(spark, path),
        "segment_loss": inputs.segments(spark, path),
        "model_metrics": inputs.metrics(spark, path),
        "recommendations": recommend.recommend(summary),
        "cancellations_classified": inputs.classified_cancellations(spark, path),
        "support_tickets_classified": inputs.classified_tickets(spark, path),
        "sales_notes_classified": inputs.classified_notes_with_account(spark, path),
    }
    return exports.count_manifest(exports.build_extracts(outputs))


@register("s09_run_summary", f"""
    select (select count(*) from risk) as risk_rows,
           (select {money('lost_revenue')} from summary) as revenue_loss_total""")
def run_summary(spark, path):
    scores = inputs.risk(spark, path).select("account_id")
    losses = inputs.summary(spark, path).select("lost_revenue")
    return scores.unionByName(losses, allowMissingColumns=True).agg(
        F.count("account_id").alias("risk_rows"),
        money_sum(F.col("lost_revenue")).alias("revenue_loss_total"),
    )


# ---- projections, filters, predicates ---------------------------------------------------------


@register("p01_lost_deals", """
    select deal_id, account_id, deal_value, discount_pct, deal_status from deals where deal_status = 'lost'""")
def lost_deals(spark, path):
    return ledger.lost_deals(star.deals(spark, path)).select(
        "deal_id", "account_id", "deal_value", "discount_pct", "deal_status"
    )


@register("p02_choose_plan_and_region", """
    select account_id, plan_type, region, churn_probability from risk
    where plan_type in ('pro', 'team') and region in ('ASIA', 'EUROPE')""")
def choose_plan_and_region(spark, path):
    return views.choose(inputs.risk(spark, path), ["pro", "team"], ["ASIA", "EUROPE"]).select(
        "account_id", "plan_type", "region", "churn_probability"
    )


@register("p03_probability_threshold", """
    select account_id, churn_probability from risk where churn_probability >= 0.25::double""")
def probability_threshold(spark, path):
    return views.at_risk(inputs.risk(spark, path), 0.25).select("account_id", "churn_probability")


@register("p04_ticket_flags", """
    select ticket_id, cast(priority = 'high' as integer) as is_high_priority,
           cast(ticket_type = 'performance_issue' as integer) as is_performance,
           cast(ticket_type = 'billing' as integer) as is_billing,
           cast(ticket_type = 'feature_request' as integer) as is_feature_request from support_tickets""")
def ticket_flags(spark, path):
    kind = F.col("ticket_type")
    return star.support_tickets(spark, path).select(
        "ticket_id",
        flag(F.col("priority") == "high").alias("is_high_priority"),
        flag(kind == "performance_issue").alias("is_performance"),
        flag(kind == "billing").alias("is_billing"),
        flag(kind == "feature_request").alias("is_feature_request"),
    )


@register("p04_deal_flags", """
    select deal_id, cast(deal_status = 'lost' as integer) as is_lost,
           cast(competitor_mentioned <> 'None' as integer) as competitor_mention from deals""")
def deal_flags(spark, path):
    return star.deals(spark, path).select(
        "deal_id",
        flag(F.col("deal_status") == "lost").alias("is_lost"),
        flag(attribution.mentions_competitor(F.col("competitor_mentioned"))).alias("competitor_mention"),
    )


@register("p05_fallback_cause", """
    select deal_id, deal_loss_category, deal_loss_subcategory from attributed
    where deal_id not in (select deal_id from sales_notes)""")
def fallback_cause(spark, path):
    noted = star.sales_notes(spark, path).select("deal_id").distinct().withColumn("noted", F.lit(True))
    bare = star.deals(spark, path).join(noted, "deal_id", "left").where(F.col("noted").isNull())
    empty = {c: F.lit(None).cast("string") for c in ("deal_loss_category", "deal_loss_subcategory")}
    unexplained = bare.withColumns({**empty, "deal_loss_confidence": F.lit(None).cast("double")})
    return attribution.fill_cause(unexplained).select("deal_id", "deal_loss_category", "deal_loss_subcategory")


@register("p06_fill_default_cause", """
    select deal_loss_category, deal_loss_subcategory, deal_loss_confidence, count(*) as deals
    from attributed group by 1, 2, 3""")
def fill_default_cause(spark, path):
    keys = ["deal_loss_category", "deal_loss_subcategory", "deal_loss_confidence"]
    return inputs.attributed(spark, path).groupBy(*keys).agg(F.count(F.lit(1)).alias("deals"))


@register("p07_fill_zero", """
    select account_id, coalesce(avg_projects_created, 0) as avg_projects_created,
           coalesce(avg_exports, 0) as avg_exports, coalesce(avg_weekly_active_users, 0) as avg_weekly_active_users
    from accounts left join usage_means using (account_id)""")
def fill_zero(spark, path):
    means = features.usage_means(star.product_usage(spark, path))
    shown = ["avg_projects_created", "avg_exports", "avg_weekly_active_users"]
    return star.accounts(spark, path).join(means, "account_id", "left").na.fill(0, shown).select("account_id", *shown)


@register("p08_renamed_note_columns", """
    select note_id, deal_id, category as deal_loss_category, subcategory as deal_loss_subcategory,
           confidence as deal_loss_confidence from notes_classified""")
def renamed_note_columns(spark, path):
    return inputs.classified_notes(spark, path).select(
        "note_id",
        "deal_id",
        F.col("category").alias("deal_loss_category"),
        F.col("subcategory").alias("deal_loss_subcategory"),
        F.col("confidence").alias("deal_loss_confidence"),
    )


@register("p09_effective_deal_value", """
    select deal_id, deal_value * (1 - discount_pct / 100.0::double) as effective_deal_value from deals""")
def effective_deal_value(spark, path):
    value = attribution.effective_value(F.col("deal_value"), F.col("discount_pct"))
    return star.deals(spark, path).select("deal_id", value.alias("effective_deal_value"))


@register("p10_constant_columns", """
    select source, count(*) as records, 0.5::double as risk_threshold_default from (
        select 'churn' as source from cancellations
        union all select 'lost_deal' from deals where deal_status = 'lost') group by source""")
def constant_columns(spark, path):
    tagged = inputs.events(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("records"))
    return tagged.withColumn("risk_threshold_default", F.lit(0.5))


@register("p11_filtered_totals", f"""
    select (select {money('deal_value')} from deals where deal_status = 'lost') as lost_pipeline,
           (select {money('deal_value')} from deals where deal_status = 'won') as won_pipeline""")
def filtered_totals(spark, path):
    status, value = F.col("deal_status"), F.col("deal_value")
    return star.deals(spark, path).agg(
        money_sum(F.when(status == "lost", value)).alias("lost_pipeline"),
        money_sum(F.when(status == "won", value)).alias("won_pipeline"),
    )


@register("p12_preview", """
    select account_id, company_size, industry, region, plan_type, cast(signup_date as varchar) as signup_date,
           monthly_revenue from accounts order by account_id limit 5""")
def preview(spark, path):
    return star.accounts(spark, path).orderBy("account_id").limit(5)


@register("p12_shapes", """
    select 'accounts' as table_name, count(*) as row_count, 7 as column_count from accounts
    union all select 'deals', count(*), 10 from deals
    union all select 'product_usage', count(*), 8 from product_usage
    union all select 'support_tickets', count(*), 8 from support_tickets
    union all select 'sales_notes', count(*), 4 from sales_notes
    union all select 'cancellations', count(*), 7 from cancellations""")
def shapes(spark, path):
    named = {
        "accounts": star.accounts,
        "deals": star.deals,
        "product_usage": star.product_usage,
        "support_tickets": star.support_tickets,
        "sales_notes": star.sales_notes,
        "cancellations": star.cancellations,
    }
    return profile.union_all([profile.shape(read(spark, path), name) for name, read in named.items()])


@register("p13_filter_options", """
    select distinct 'plan_type' as filter, plan_type as choice from risk where plan_type is not null
    union all select distinct 'region', region from risk where region is not null""")
def filter_options(spark, path):
    return views.filter_options(inputs.risk(spark, path))


# ---- joins ------------------------------------------------------------------------------------


@register("j01_deals_with_best_note", """
    select d.deal_id, deal_status, category, subcategory, confidence
    from deals d left join best_note b on b.deal_id = d.deal_id""")
def deals_with_best_note(spark, path):
    best = attribution.best_note_per_deal(inputs.classified_notes(spark, path))
    return star.deals(spark, path).join(best, "deal_id", "left").select(
        "deal_id",
        "deal_status",
        F.col("deal_loss_category").alias("category"),
        F.col("deal_loss_subcategory").alias("subcategory"),
        F.col("deal_loss_confidence").alias("confidence"),
    )


@register("j02_account_star", """
    select a.account_id, u.account_id is not null as has_usage, s.account_id is not null as has_tickets,
           d.account_id is not null as has_deals, c.account_id is not null as has_cancelled
    from accounts a left join usage_means u on u.account_id = a.account_id
         left join support_summary s on s.account_id = a.account_id
         left join deal_summary d on d.account_id = a.account_id
         left join (select distinct account_id from cancellations) c on c.account_id = a.account_id""")
def account_star(spark, path):
    tables = star.star_tables(spark, path)
    joined = tables.accounts.join(features.account_activity(tables), "account_id", "left")
    return joined.select(
        "account_id",
        F.col("avg_projects_created").isNotNull().alias("has_usage"),
        F.col("ticket_count").isNotNull().alias("has_tickets"),
        F.col("total_deals").isNotNull().alias("has_deals"),
        F.col("is_churned").isNotNull().alias("has_cancelled"),
    )


@register("j03_churn_with_account", """
    select cancellation_id, account_id, plan_type, region, industry, churned_revenue
    from cancellations left join accounts using (account_id)""")
def churn_with_account(spark, path):
    dims = star.accounts(spark, path).select("account_id", *rollups.SEGMENT)
    return lookup_join(star.cancellations(spark, path), dims, "account_id", "cancellation_id").select(
        "cancellation_id", "account_id", *rollups.SEGMENT, "churned_revenue"
    )


@register("j04_lost_deals_with_account", """
    select deal_id, account_id, plan_type, region, industry, deal_value
    from deals left join accounts using (account_id) where deal_status = 'lost'""")
def lost_deals_with_account(spark, path):
    dims = star.accounts(spark, path).select("account_id", *rollups.SEGMENT)
    lost = ledger.lost_deals(star.deals(spark, path))
    return lookup_join(lost, dims, "account_id", "deal_id").select("deal_id", "account_id", *rollups.SEGMENT, "deal_value")


@register("j05_trend_of_both_sources", """
    select period, churn_events, lost_deal_events from trend""")
def trend_of_both_sources(spark, path):
    return inputs.trend(spark, path).select("period", "churn_events", "lost_deal_events")


@register("j06_segments_of_both_sources", """
    select plan_type, region, industry, churn_events, lost_deal_events from segments""")
def segments_of_both_sources(spark, path):
    return inputs.segments(spark, path).select(*rollups.SEGMENT, "churn_events", "lost_deal_events")


@register("j07_action_per_category", """
    select s.category, s.subcategory, s.source,
           coalesce(action, (select action from playbook where category = 'Uncategorized')) as recommended_action
    from summary s left join playbook p on p.category = s.category""")
def action_per_category(spark, path):
    return recommend.with_action(inputs.summary(spark, path)).select(
        "category", "subcategory", "source", "recommended_action"
    )


@register("j08_metric_labels", """
    select period, 'churn_revenue_lost' as metric, 'Churn Revenue Lost' as metric_label from trend
    union all select period, 'churn_events', 'churn_events' from trend""")
def metric_labels(spark, path):
    measures = F.explode(F.array(F.lit("churn_revenue_lost"), F.lit("churn_events")))
    long = inputs.trend(spark, path).select("period", measures.alias("metric"))
    return long.withColumn("metric_label", lookup_label(F.col("metric")))


@register("j09_accounts_with_usage", """
    select account_id, plan_type, projects_created, templates_used, ai_design_tool_usage, exports_count,
           collaboration_sessions, weekly_active_users from account_usage""")
def accounts_with_usage(spark, path):
    joined = profile.account_usage(star.accounts(spark, path), star.product_usage(spark, path))
    return joined.select("account_id", "plan_type", *features.USAGE_MEANS)


@register("j10_accounts_with_tickets", """
    select account_id, churned, coalesce(ticket_count, 0) as ticket_count,
           coalesce(avg_resolution_hours, 0) as avg_resolution_hours, coalesce(avg_csat, 0) as avg_csat
    from account_usage left join support_summary using (account_id)""")
def accounts_with_tickets(spark, path):
    return health(spark, path).select("account_id", "churned", "ticket_count", "avg_resolution_hours", "avg_csat")


def health(spark, path):
    tables = star.star_tables(spark, path)
    return profile.account_health(tables.accounts, tables.usage, tables.support, tables.cancellations)


@register("j11_churned_flag", """
    select account_id, churned from account_usage""")
def churned_flag(spark, path):
    return profile.with_churned(star.accounts(spark, path), star.cancellations(spark, path)).select(
        "account_id", "churned"
    )


@register("j12_engagement_for_scores", """
    select account_id, monthly_revenue, avg_projects_created, avg_weekly_active_users from churn_scores""")
def engagement_for_scores(spark, path):
    return inputs.propensity(spark, path).select(
        "account_id", "monthly_revenue", "avg_projects_created", "avg_weekly_active_users"
    )
