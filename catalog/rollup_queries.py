"""Aggregations, windows, sorting and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import inputs
from catalog.basics import health
from catalog.registry import register
from catalog.sql_views import cents, money
from lossledger.functions.numbers import round_half_even
from lossledger.operators import attribution, features, ledger, profile, recommend, rollups
from lossledger.plans import views
from lossledger.plans.run import total_loss
from lossledger.sources import star_schema as star

# ---- aggregations -----------------------------------------------------------------------------


@register("a01_usage_means", "select * from usage_means")
def usage_means(spark, path):
    return features.usage_means(star.product_usage(spark, path))


@register("a02_recent_usage_means", "select * from recent_means")
def recent_usage_means(spark, path):
    return features.recent_means(star.product_usage(spark, path))


@register("a03_support_per_account", "select * from support_summary")
def support_per_account(spark, path):
    return features.support_summary(star.support_tickets(spark, path))


@register("a04_deals_per_account", """
    select account_id, total_deals, lost_deals, avg_discount_pct, avg_deal_value, competitor_mention_rate
    from deal_summary""")
def deals_per_account(spark, path):
    return features.deal_summary(star.deals(spark, path)).drop("lost_deal_rate")


@register("a05_lost_deal_rate", "select account_id, lost_deal_rate from deal_summary")
def lost_deal_rate(spark, path):
    return features.deal_summary(star.deals(spark, path)).select("account_id", "lost_deal_rate")


@register("a06_churn_labels", "select distinct account_id, 1 as is_churned from cancellations")
def churn_labels(spark, path):
    return features.churn_labels(star.cancellations(spark, path))


def _by_cause(spark, path, source):
    tagged = rollups.loss_by_cause(inputs.ledger(spark, path).where(F.col("source") == source))
    return tagged.drop("source")


@register("a07_churn_by_cause", f"""
    select category, subcategory, source_records, {cents('lost_revenue')} as lost_revenue from churn_by_cause""")
def churn_by_cause(spark, path):
    return _by_cause(spark, path, ledger.CHURN)


@register("a08_lost_deals_by_cause", f"""
    select category, subcategory, source_records, {cents('lost_revenue')} as lost_revenue from deals_by_cause""")
def lost_deals_by_cause(spark, path):
    return _by_cause(spark, path, ledger.LOST_DEAL)


@register("a09_loss_summary", "select * from summary")
def loss_summary(spark, path):
    return inputs.summary(spark, path, ordered=True)


@register("a10_churn_by_month", "select * from churn_by_month")
def churn_by_month(spark, path):
    return rollups.source_trend(inputs.events(spark, path), ledger.CHURN)


@register("a11_lost_deals_by_month", "select * from deals_by_month")
def lost_deals_by_month(spark, path):
    return rollups.source_trend(inputs.events(spark, path), ledger.LOST_DEAL)


@register("a12_loss_trend", "select * from trend")
def loss_trend(spark, path):
    return inputs.trend(spark, path)


@register("a13_churn_by_segment", "select * from churn_by_segment")
def churn_by_segment(spark, path):
    return rollups.source_segments(inputs.events(spark, path), star.accounts(spark, path), ledger.CHURN)


@register("a14_lost_deals_by_segment", "select * from deals_by_segment")
def lost_deals_by_segment(spark, path):
    return rollups.source_segments(inputs.events(spark, path), star.accounts(spark, path), ledger.LOST_DEAL)


@register("a15_segment_loss", "select * from segments")
def segment_loss(spark, path):
    return inputs.segments(spark, path)


@register("a16_loss_by_category", """
    select category, cast(sum(cast(lost_revenue as decimal(28,4))) as double) as total_lost_revenue,
           cast(sum(source_records) as bigint) as source_records from summary group by category""")
def loss_by_category(spark, path):
    return recommend.loss_by_category(inputs.summary(spark, path))


@register("a17_loss_by_category_and_source", f"""
    select category, source, {money('lost_revenue')} as lost_revenue from summary
    where category is not null group by category, source""")
def loss_by_category_and_source(spark, path):
    return views.loss_chart(inputs.summary(spark, path))


@register("a18_loss_breakdown", "select * from summary")
def loss_breakdown(spark, path):
    return views.breakdown(inputs.summary(spark, path))


@register("a19_kpi_snapshot", f"""
    select (select {money('estimated_monthly_revenue_at_risk')} from risk) as monthly_revenue_at_risk,
           (select count(*) from risk where churn_probability >= 0.5) as high_risk_accounts_at_0_50,
           (select {money('lost_revenue')} from summary where source = 'churn') as modeled_churn_loss,
           (select {money('lost_revenue')} from summary where source = 'lost_deal') as modeled_lost_deal_value,
           (select cast(sum(cast(churn_probability as decimal(20,12))) as double) / count(*) from risk)
             as average_churn_probability,
           0.5::double as default_risk_threshold""")
def kpi_snapshot(spark, path):
    return views.kpi_snapshot(inputs.risk(spark, path), inputs.summary(spark, path))


@register("a20_filtered_kpis", f"""
    select {money('estimated_monthly_revenue_at_risk')} as total_revenue_at_risk,
           count(*) filter (churn_probability >= 0.2::double) as critical_accounts,
           cast(sum(cast(churn_probability as decimal(20,12))) as double) / count(*) as mean_risk
    from risk where plan_type in ('pro', 'team') and region in ('ASIA', 'EUROPE')""")
def filtered_kpis(spark, path):
    chosen = views.choose(inputs.risk(spark, path), ["pro", "team"], ["ASIA", "EUROPE"])
    return views.risk_kpis(chosen, threshold=0.2)


def _null_sql(table, columns):
    return " union all ".join(
        f"select '{table}' as table_name, '{c}' as column_name, count(*) filter ({c} is null) as nulls from {table}"
        for c in columns
    )


TABLE_COLUMNS = {
    "accounts": "account_id company_size industry region plan_type signup_date monthly_revenue".split(),
    "deals": "deal_id account_id lead_source created_date deal_value discount_pct competitor_mentioned stage "
             "close_date deal_status".split(),
    "product_usage": ["account_id", "week_start", *features.USAGE_MEANS],
    "support_tickets": "ticket_id account_id created_date ticket_type priority resolution_hours csat_score "
                       "ticket_summary".split(),
    "sales_notes": "note_id deal_id note_date note_text".split(),
    "cancellations": "cancellation_id account_id cancellation_date refund_requested cancellation_reason_text "
                     "churned_revenue reason_type".split(),
}


@register("a21_null_counts", " union all ".join(_null_sql(t, c) for t, c in TABLE_COLUMNS.items()))
def null_counts(spark, path):
    return profile.union_all(
        [profile.null_counts(getattr(star, t)(spark, path), t) for t in TABLE_COLUMNS]
    )


COUNTED = {
    "competitor_mentioned": "deals",
    "plan_type": "accounts",
    "company_size": "accounts",
    "deal_status": "deals",
    "ticket_type": "support_tickets",
    "reason_type": "cancellations",
}


@register("a22_value_counts", " union all ".join(
    f"select '{c}' as column_name, {c} as value, count(*) as occurrences from {t} group by {c}"
    for c, t in COUNTED.items()
))
def value_counts(spark, path):
    return profile.union_all(
        [
            profile.value_counts(getattr(star, t)(spark, path), c, dropna=c != "competitor_mentioned").select(
                F.lit(c).alias("column_name"), "value", "occurrences"
            )
            for c, t in COUNTED.items()
        ]
    )


@register("a23_describe_revenue", """
    with s as (select monthly_revenue as x from accounts)
    select 'count' as statistic, count(x)::double as value from s
    union all select 'mean', avg(x) from s
    union all select 'std', round_even(stddev_samp(x) * 1e6::double, 0) / 1e6::double from s
    union all select 'min', min(x) from s
    union all select '25%', quantile_cont(x, 0.25) from s
    union all select '50%', quantile_cont(x, 0.5) from s
    union all select '75%', quantile_cont(x, 0.75) from s
    union all select 'max', max(x) from s""")
def describe_revenue(spark, path):
    described = profile.describe(star.accounts(spark, path), "monthly_revenue")
    rounded = F.when(F.col("statistic") == "std", round_half_even(F.col("value"), 6)).otherwise(F.col("value"))
    return described.withColumn("value", rounded)


@register("a23_describe_deal_value", """
    with s as (select deal_value as x from deals)
    select 'min' as statistic, min(x) as value from s
    union all select '25%', round_even(quantile_cont(x, 0.25) * 1e6::double, 0) / 1e6::double from s
    union all select '50%', round_even(quantile_cont(x, 0.5) * 1e6::double, 0) / 1e6::double from s
    union all select '75%', round_even(quantile_cont(x, 0.75) * 1e6::double, 0) / 1e6::double from s
    union all select 'max', max(x) from s""")
def describe_deal_value(spark, path):
    described = profile.describe(star.deals(spark, path), "deal_value")
    return described.where(~F.col("statistic").isin("count", "mean", "std")).withColumn(
        "value", round_half_even(F.col("value"), 6)
    )


@register("a24_revenue_histogram", """
    with s as (select monthly_revenue as x, min(monthly_revenue) over () as lo, max(monthly_revenue) over () as hi
               from accounts where monthly_revenue is not null),
         b as (select cast(i as integer) as bin from range(20) r(i)),
         e as (select min(lo) as lo, (max(hi) - min(lo)) / 20 as width from s)
    select bin, lo + bin * width as lower, lo + (bin + 1) * width as upper,
           (select count(*) from s where s.x >= e.lo + bin * width
              and (s.x < e.lo + (bin + 1) * width or (bin = 19 and s.x <= s.hi))) as occurrences
    from b, e""")
def revenue_histogram(spark, path):
    return profile.histogram(star.accounts(spark, path), "monthly_revenue", 20)


@register("a25_win_rate_by_competitor", """
    select competitor_mentioned, avg(cast(deal_status = 'won' as integer)) as win_rate from deals group by 1""")
def win_rate_by_competitor(spark, path):
    return profile.win_rate_by_competitor(star.deals(spark, path))


@register("a26_usage_per_account", """
    select account_id, avg(projects_created) as projects_created, avg(templates_used) as templates_used,
           avg(ai_design_tool_usage) as ai_design_tool_usage, avg(exports_count) as exports_count,
           avg(collaboration_sessions) as collaboration_sessions, avg(weekly_active_users) as weekly_active_users
    from product_usage group by 1""")
def usage_per_account(spark, path):
    return profile.mean_by(star.product_usage(spark, path), "account_id", *features.USAGE_MEANS)


def _mean(column):
    """Order-independent mean of a fractional column, in both engines."""
    return f"cast(sum(cast({column} as decimal(20,9))) as double) / count({column})"


@register("a27_usage_by_plan", f"""
    select plan_type, {_mean('projects_created')} as projects_created,
           {_mean('weekly_active_users')} as weekly_active_users,
           {_mean('collaboration_sessions')} as collaboration_sessions from account_usage group by 1""")
def usage_by_plan(spark, path):
    joined = profile.account_usage(star.accounts(spark, path), star.product_usage(spark, path))
    return profile.mean_by(joined, "plan_type", "projects_created", "weekly_active_users", "collaboration_sessions")


def _place(df, name):
    """The place of each row of a small sorted result, so that its order is compared too."""
    return df.withColumn("_id", F.monotonically_increasing_id()).withColumn(
        name, F.row_number().over(Window.orderBy("_id"))).drop("_id")


@register("a28_support_by_type", """
    select ticket_type, csat_score, resolution_hours,
           cast(row_number() over (order by csat_score, ticket_type) as integer) as by_csat,
           cast(row_number() over (order by resolution_hours, ticket_type) as integer) as by_hours
    from (select ticket_type, avg(csat_score) as csat_score, avg(resolution_hours) as resolution_hours
          from support_tickets group by 1)""")
def support_by_type(spark, path):
    tickets = star.support_tickets(spark, path)
    csat = profile.mean_by(tickets, "ticket_type", "csat_score", by="csat_score")
    hours = profile.mean_by(tickets, "ticket_type", "resolution_hours", by="resolution_hours")
    return _place(csat, "by_csat").join(_place(hours, "by_hours"), "ticket_type")


@register("a29_churn_overview", f"""
    select 'all' as reason_type, count(*) as cancellations, {money('churned_revenue')} as churned_revenue
    from cancellations
    union all select reason_type, count(*), {money('churned_revenue')} from cancellations
    where reason_type is not null group by reason_type""")
def churn_overview(spark, path):
    return profile.churn_overview(star.cancellations(spark, path))


@register("a30_usage_by_churned", f"""
    select churned, {_mean('projects_created')} as projects_created,
           {_mean('weekly_active_users')} as weekly_active_users, {_mean('templates_used')} as templates_used
    from account_usage group by 1""")
def usage_by_churned(spark, path):
    return profile.mean_by(health(spark, path), "churned", "projects_created", "weekly_active_users", "templates_used")


@register("a31_ticket_summary", """
    select account_id, ticket_count, avg_resolution_hours, avg_csat from support_summary""")
def ticket_summary(spark, path):
    return profile.ticket_summary(star.support_tickets(spark, path))


@register("a31_support_by_churned", f"""
    with h as (select churned, coalesce(ticket_count, 0) as ticket_count,
                      coalesce(avg_resolution_hours, 0) as avg_resolution_hours, coalesce(avg_csat, 0) as avg_csat
               from account_usage left join support_summary using (account_id))
    select churned, {_mean('ticket_count')} as ticket_count, {_mean('avg_resolution_hours')} as avg_resolution_hours,
           {_mean('avg_csat')} as avg_csat from h group by 1""")
def support_by_churned(spark, path):
    return profile.mean_by(health(spark, path), "churned", "ticket_count", "avg_resolution_hours", "avg_csat")


@register("a32_total_loss", f"select {money('lost_revenue')} as revenue_loss_total from summary")
def run_total_loss(spark, path):
    return total_loss(inputs.summary(spark, path))


@register("a33_positive_rate", "select avg(churned) as positive_rate from account_usage")
def positive_rate(spark, path):
    flagged = profile.with_churned(star.accounts(spark, path), star.cancellations(spark, path))
    return flagged.agg(F.avg("churned").alias("positive_rate"))


@register("a34_source_totals", f"""
    select (select {money('lost_revenue')} from summary where source = 'churn') as modeled_churn_loss,
           (select {money('lost_revenue')} from summary where source = 'lost_deal') as modeled_lost_deal_value""")
def source_totals(spark, path):
    return views.source_totals(inputs.summary(spark, path))


# ---- windows ----------------------------------------------------------------------------------


@register("w01_recent_weeks", """
    select account_id, cast(week_start as varchar) as week_start, projects_created, weekly_active_users
    from recent_usage""")
def recent_weeks(spark, path):
    return features.recent_weeks(star.product_usage(spark, path))


@register("w02_best_note", """
    select deal_id, category as deal_loss_category, subcategory as deal_loss_subcategory,
           confidence as deal_loss_confidence from best_note""")
def best_note(spark, path):
    return attribution.best_note_per_deal(inputs.classified_notes(spark, path))


@register("w03_percent_of_total", "select category, subcategory, source, pct_of_total_loss from summary")
def percent_of_total(spark, path):
    return inputs.summary(spark, path, ordered=True).select("category", "subcategory", "source", "pct_of_total_loss")


@register("w04_priority", "select priority, category from recommendations")
def priority(spark, path):
    return recommend.recommend(inputs.summary(spark, path)).select("priority", "category")


# ---- sort, limit, top-k -----------------------------------------------------------------------


@register("l01_summary_by_loss", """
    select category, subcategory, source, lost_revenue, cast(row_number() over (
        order by lost_revenue desc, category nulls first, subcategory nulls first, source) as integer) as position from summary""")
def summary_by_loss(spark, path):
    summary = inputs.summary(spark, path, ordered=True).select("category", "subcategory", "source", "lost_revenue")
    return _place(summary, "position")


@register("l02_trend_by_period", """
    select period, total_revenue_loss, cast(row_number() over (
        order by period nulls last) as integer) as position from trend""")
def trend_by_period(spark, path):
    return _place(inputs.trend(spark, path, ordered=True).select("period", "total_revenue_loss"), "position")


@register("l03_segments_by_loss", """
    select plan_type, region, industry, total_revenue_loss, cast(row_number() over (
        order by total_revenue_loss desc, plan_type nulls first, region nulls first, industry nulls first) as integer)
        as position
    from segments""")
def segments_by_loss(spark, path):
    segments = inputs.segments(spark, path, ordered=True)
    return _place(segments.select(*rollups.SEGMENT, "total_revenue_loss"), "position")


@register("l04_scores_by_risk", """
    select account_id, churn_probability, estimated_monthly_revenue_at_risk from risk order by 3 desc, 2 desc, 1""")
def scores_by_risk(spark, path):
    return inputs.risk(spark, path, ordered=True).select("account_id", "churn_probability", "estimated_monthly_revenue_at_risk")


@register("l05_top_categories", """
    select category, total_lost_revenue, source_records from recommendations""")
def top_categories(spark, path):
    return recommend.recommend(inputs.summary(spark, path)).select("category", "total_lost_revenue", "source_records")


@register("l06_top_accounts_at_risk", """
    select account_id, plan_type, region, industry, churn_probability, risk_tier, monthly_revenue,
           estimated_monthly_revenue_at_risk
    from risk where churn_probability >= 0.2::double
    order by estimated_monthly_revenue_at_risk desc, churn_probability desc, account_id limit 50""")
def top_accounts_at_risk(spark, path):
    return views.top_at_risk(inputs.risk(spark, path), threshold=0.2)


@register("l07_top_segments", """
    select *, plan_type || ' | ' || region || ' | ' || industry as segment from segments
    order by total_revenue_loss desc, plan_type, region, industry limit 25""")
def top_segments(spark, path):
    return views.top_segments(inputs.segments(spark, path))


@register("l08_newest_cancellations", """
    select account_id, cast(cancellation_date as varchar) as cancellation_date, churned_revenue, category, subcategory
    from cancellations_classified order by cancellation_date desc""")
def newest_cancellations(spark, path):
    newest = views.evidence_from_text(star.cancellations(spark, path), "cancellations")
    return newest.drop("cancellation_reason_text")
