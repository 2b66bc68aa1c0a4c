"""Set operations and reshaping, scalar functions, text taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs
from catalog.registry import register
from catalog.sql_views import money
from lossledger.functions.dates import days_until, month_of
from lossledger.functions.numbers import clamp_low, money_sum, round_half_even
from lossledger.functions.text import is_blank
from lossledger.operators import ledger
from lossledger.operators.scoring import revenue_at_risk, risk_tier
from lossledger.operators.taxonomy import classify, classify_indexed, rules_table
from lossledger.plans import views
from lossledger.session import dealt_out
from lossledger.settings import AS_OF
from lossledger.sources import star_schema as star

# ---- set operations and reshaping -------------------------------------------------------------


@register("u01_union_of_losses", f"""
    select 'churn' as source, count(*) as records, {money('churned_revenue')} as amount from cancellations
    union all
    select 'lost_deal', count(*), {money('deal_value * (1 - discount_pct / 100.0::double)')}
    from deals where deal_status = 'lost'""")
def union_of_losses(spark, path):
    return inputs.events(spark, path).groupBy("source").agg(
        F.count("record_id").alias("records"), money_sum(F.col("amount")).alias("amount")
    )


@register("u02_classifier_columns", """
    select note_id, deal_id, cast(note_date as varchar) as note_date, note_text, category, subcategory,
           matched_terms, confidence from notes_classified""")
def classifier_columns(spark, path):
    return inputs.classified_notes(spark, path)


@register("u03_trend_long", """
    select period, metric, value, label as metric_label from (
        select period, 'churn_revenue_lost' as metric, churn_revenue_lost as value, 'Churn Revenue Lost' as label
        from trend
        union all select period, 'lost_deal_value', lost_deal_value, 'Lost Deal Value' from trend
        union all select period, 'total_revenue_loss', total_revenue_loss, 'Total Revenue Loss' from trend)""")
def trend_long(spark, path):
    return views.trend_long(inputs.trend(spark, path))


@register("u04_metrics_long", """
    select 'roc_auc' as metric, 'ROC_AUC' as metric_label, case when roc_auc <= 1 then roc_auc else 0.0::double end as metric_value from metrics
    union all select 'pr_auc', 'PR_AUC', pr_auc from metrics
    union all select 'accuracy', 'ACCURACY', accuracy from metrics
    union all select 'recall', 'RECALL', recall from metrics
    union all select 'f1', 'F1', f1 from metrics
    union all select 'optimal_threshold', 'OPTIMAL_THRESHOLD', optimal_threshold from metrics
    union all select 'positive_rate', 'POSITIVE_RATE', 0.0::double""")
def metrics_long(spark, path):
    # One metric is left out, so its row must read 0.
    return views.metrics_long(inputs.metrics(spark, path).drop("positive_rate"))


# ---- scalar functions -------------------------------------------------------------------------


@register("f01_lower", "select doc_id, lower(text) as lowered from documents")
def lower(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet").select("doc_id", F.lower("text").alias("lowered"))


@register("f02_contains", """
    select ticket_id, contains(lower(ticket_summary), 'export') as mentions_export,
           contains(lower(ticket_summary), 'pricing') as mentions_pricing from support_tickets""")
def contains(spark, path):
    text = F.lower("ticket_summary")
    return star.support_tickets(spark, path).select(
        "ticket_id",
        F.contains(text, F.lit("export")).alias("mentions_export"),
        F.contains(text, F.lit("pricing")).alias("mentions_pricing"),
    )


@register("f03_blank", r"""
    select doc_id, not regexp_matches(text, '\S') as as_given,
           not regexp_matches(regexp_replace(text, '\S', '', 'g'), '\S') as emptied from documents""")
def blank(spark, path):
    # The second column drops all that is not white space and tests what is left of each text.
    spaces = F.regexp_replace("text", r"(?U)\S", "")
    return spark.read.parquet(f"{path}/documents.parquet").select(
        "doc_id", is_blank(F.col("text")).alias("as_given"), is_blank(spaces).alias("emptied")
    )


@register("f04_matched_terms", "select ticket_id, matched_terms from tickets_classified")
def matched_terms(spark, path):
    return inputs.classified_tickets(spark, path).select("ticket_id", "matched_terms")


@register("f05_segment_label", """
    select plan_type || ' | ' || region || ' | ' || industry as segment, total_revenue_loss from segments""")
def segment_label(spark, path):
    return views.with_segment(inputs.segments(spark, path)).select("segment", "total_revenue_loss")


@register("f06_upper", "select c_custkey, upper(lower(c_name)) as label from customer")
def upper(spark, path):
    customer = spark.read.parquet(f"{path}/customer.parquet")
    return customer.select("c_custkey", F.upper(F.lower("c_name")).alias("label"))


@register("f07_parse_day", """
    select deal_id, cast(created_date as varchar) as created_date, year(created_date) as created_year from deals""")
def parse_day(spark, path):
    text = F.date_format("created_date", "yyyy-MM-dd")
    day = F.to_date(text, "yyyy-MM-dd")
    return star.deals(spark, path).select(
        "deal_id", day.alias("created_date"), F.year(day).cast("bigint").alias("created_year")
    )


@register("f08_month", "select deal_id, strftime(close_date, '%Y-%m') as period from deals")
def month(spark, path):
    return star.deals(spark, path).select("deal_id", month_of(F.col("close_date")).alias("period"))


@register("f09_account_age", """
    select account_id, datediff('day', signup_date, date '2026-03-12') as account_age_days from accounts
    where signup_date is not null""")
def account_age(spark, path):
    return star.accounts(spark, path).where(F.col("signup_date").isNotNull()).select(
        "account_id", days_until(AS_OF, F.col("signup_date")).cast("bigint").alias("account_age_days")
    )


@register("f10_tenure_months", """
    select cancellation_id, account_id,
           greatest(1, cast(trunc(datediff('day', signup_date, cancellation_date) / 30) as integer)) as tenure_months
    from cancellations left join accounts using (account_id)""")
def tenure(spark, path):
    dated = star.with_tenure(star.cancellations(spark, path), star.accounts(spark, path))
    return dated.select("cancellation_id", "account_id", "tenure_months")


@register("f11_round", """
    select deal_id, round_even(deal_value * 0.125::double * 100.0::double, 0) / 100.0::double as rounded from deals""")
def rounded(spark, path):
    return star.deals(spark, path).select("deal_id", round_half_even(F.col("deal_value") * 0.125).alias("rounded"))


@register("f12_clamp", """
    select deal_id, greatest(discount_pct, 15) as floored, least(0.95::double, discount_pct / 20.0::double) as capped
    from deals""")
def clamp(spark, path):
    discount = F.col("discount_pct")
    return star.deals(spark, path).select(
        "deal_id", clamp_low(discount, 15).alias("floored"), F.least(F.lit(0.95), discount / 20.0).alias("capped")
    )


@register("f13_tiers", """
    select deal_id, case when p > -0.01 and p <= 0.25 then 'Low' when p > 0.25 and p <= 0.5 then 'Medium'
           when p > 0.5 and p <= 0.75 then 'High' when p > 0.75 and p <= 1 then 'Critical' end as tier
    from (select deal_id, discount_pct / 20.0::double as p from deals)""")
def tiers(spark, path):
    return star.deals(spark, path).select("deal_id", risk_tier(F.col("discount_pct") / 20.0).alias("tier"))


@register("f14_expected_loss", "select account_id, estimated_monthly_revenue_at_risk from risk")
def expected_loss(spark, path):
    at_risk = revenue_at_risk(F.col("monthly_revenue"), F.col("churn_probability"))
    return inputs.propensity(spark, path).select("account_id", at_risk.alias("estimated_monthly_revenue_at_risk"))


# ---- text taxonomy ----------------------------------------------------------------------------


@register("t01_classify_documents", """
    select doc_id, category, subcategory, matched_terms, confidence from documents_classified""")
def classify_documents(spark, path):
    """Long free text with few hits."""
    documents = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    return classify(documents, "text").drop("text")


@register("t02_rule_hits", """
    select category, subcategory, count(*) as notes from notes_classified group by 1, 2""")
def rule_hits(spark, path):
    """The rules as a table, found through the index of their keywords; only the ids travel to other tasks."""
    notes = star.with_note_text(dealt_out(star.notes_without_text(spark, path).select("note_id")))
    classified = classify_indexed(notes, "note_text", rules_table(spark))
    return classified.groupBy("category", "subcategory").agg(F.count(F.lit(1)).alias("notes"))


@register("t02_rules_of_benchmark", """
    with item_rules as (
        select distinct item_id, lower(word) as keyword
        from (select item_id, unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) as word from benchmark)
    ), turns as (
        select distinct conv_id, turn, lower(text) as text from conversations
    ), hits as (
        select conv_id, turn, item_id, count(*) as hits, string_agg(keyword, ', ' order by keyword) as terms
        from turns join item_rules on contains(text, keyword) group by conv_id, turn, item_id
    ), best as (
        select * from hits qualify row_number() over (partition by conv_id, turn order by hits desc, item_id) = 1
    )
    select c.conv_id, c.turn, coalesce('Item ' || item_id, 'Uncategorized') as category, coalesce(terms, '') as matched_terms
    from conversations c left join best b on b.conv_id = c.conv_id and b.turn = c.turn""")
def rules_of_benchmark(spark, path):
    """A rule for each benchmark item, with its words as keywords; the rules grow with the table."""
    word = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0)))
    rules = spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", word.alias("keyword")).select(
        F.col("item_id").alias("rule"), F.concat(F.lit("Item "), "item_id").alias("category"), F.lit("").alias("subcategory"), "keyword")
    turns = spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "text")
    return classify_indexed(turns, "text", rules).select("conv_id", "turn", "category", "matched_terms")


@register("t03_classified_tickets", """
    select ticket_id, account_id, cast(created_date as varchar) as created_date, ticket_type, priority,
           resolution_hours, csat_score, ticket_summary, category, subcategory, matched_terms, confidence
    from tickets_classified""")
def classified_tickets(spark, path):
    return inputs.classified_tickets(spark, path)


@register("t04_classified_notes", """
    select note_id, n.deal_id, o_custkey as account_id, cast(note_date as varchar) as note_date, note_text, category,
           subcategory, matched_terms, confidence
    from notes_classified n join orders on n.deal_id = o_orderkey""")
def classified_notes(spark, path):
    return inputs.classified_notes_with_account(spark, path)


@register("t05_classified_cancellations", """
    select cancellation_id, account_id, cast(cancellation_date as varchar) as cancellation_date, refund_requested,
           cancellation_reason_text, churned_revenue, reason_type, category, subcategory, matched_terms, confidence
    from cancellations_classified""")
def classified_cancellations(spark, path):
    return inputs.classified_cancellations(spark, path)


@register("t06_attributed_deals", """
    select deal_id, account_id, lead_source, cast(created_date as varchar) as created_date, deal_value, discount_pct,
           competitor_mentioned, stage, cast(close_date as varchar) as close_date, deal_status, deal_loss_category,
           deal_loss_subcategory, deal_loss_confidence, effective_deal_value from attributed""")
def attributed_deals(spark, path):
    return inputs.attributed(spark, path)


@register("t06_attribution_by_category", f"""
    select deal_loss_category as category, count(*) as deals, {money('deal_value')} as deal_value
    from attributed where deal_status = 'lost' group by 1""")
def attribution_by_category(spark, path):
    lost = ledger.lost_deals(inputs.attributed(spark, path))
    return lost.groupBy(F.col("deal_loss_category").alias("category")).agg(
        F.count(F.lit(1)).alias("deals"), money_sum(F.col("deal_value")).alias("deal_value")
    )
