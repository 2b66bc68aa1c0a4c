"""Named SQL views for the checks: the business tables and what is derived from them.

Written separately from the Spark operators, with other means where there is a choice: rules
are a table that texts are joined to, rollups are outer joins of aggregates, curves are plain
windows.
"""

from __future__ import annotations

import re

# Fixed values, written out so that a mistake in the engine's own lists shows: rules by precedence.
RULE_ROWS = (
    ("Commercial", "pricing_concerns", "pricing price budget cost invoice billing discount renewal"),
    ("Product", "missing_templates", "template templates library variety"),
    ("Product", "missing_features", "feature capability advanced permissions controls"),
    ("Product", "performance_reliability", "slow lag crash performance failed imports unstable loading"),
    ("Product", "export_limitations", "export watermark preview"),
    ("Operational", "onboarding_confusion", "onboarding time_to_value adoption confusion setup"),
    ("Operational", "support_quality", "support resolution ticket unresolved response"),
    ("Competitive", "competitor_switch", "competitor switched canva adobe_express figma piktochart"),
    ("Competitive", "competitor_advantage", "already_uses familiarity existing_workflows stronger"),
    ("Adoption / Value Realization", "low_usage",
     "low_usage weak_adoption did_not_create limited_engagement justify_the_subscription"),
    ("Adoption / Value Realization", "low_team_adoption", "team_adoption stakeholders team_already_uses"),
)
# The action for each category.
ACTIONS = (
    ("Commercial", "Offer value-based packaging and proactive renewal outreach for price-sensitive segments."),
    ("Product", "Prioritize roadmap fixes for templates/performance gaps and publish release communication to affected accounts."),
    ("Operational", "Reduce support response time with SLA escalation for high-priority tickets and onboarding checkpoints."),
    ("Competitive", "Strengthen competitive battlecards and focus sales demos on collaboration + AI differentiation."),
    ("Adoption / Value Realization", "Launch customer success activation program for low-usage accounts within first 30 days."),
    ("Uncategorized", "Perform manual review of notes to enrich taxonomy and improve root-cause tagging quality."),
)


def _keywords(row) -> list[str]:
    return [word.replace("_", " ") for word in row[2].split()]


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _values(rows) -> str:
    return "values " + ", ".join("(" + ", ".join(str(c) for c in row) + ")" for row in rows)


def _rule_text(number: str, topic: str) -> str:
    """The text for a whole number: keywords of two rules in turn, or blank, or without keywords."""
    rules = "[" + ", ".join(_list(_keywords(r)) for r in RULE_ROWS) + "]"
    n, size = f"({number})", len(RULE_ROWS)
    first = f"{rules}[({n} // 7) % {size} + 1]"
    second = f"{rules}[({n} // 77 + 3 * {n}) % {size} + 1]"
    word = " ".join(
        f"when {i} then {r}[({n} // 5 + {i // 2}) % len({r}) + 1]" for i, r in enumerate((first, second) * 2 + (first,)))
    words = f"array_to_string([case i {word} end for i in range({n} % 5 + 1)], ' and ')"
    return (f"case {n} % 41 when 0 then '' when 1 then '   ' when 2 then '{topic}: nothing new on day ' || ({n} % 97) "
            f"else '{topic} {{' || ({n} % 97) || '}}: ' || {words} || '.' end")


def money(expression: str) -> str:
    """Exact money sum."""
    return f"cast(sum(cast({expression} as decimal(18,4))) as double)"


def cents(expression: str) -> str:
    """Two decimals, ties to even."""
    return f"(round_even(({expression}) * 100.0::double, 0) / 100.0::double)"


VIEWS: dict[str, str] = {
    "accounts": """
        select c_custkey as account_id,
               case when c_custkey % 20 < 7 then 'solo' when c_custkey % 20 < 16 then 'small_business'
                    else 'mid_market' end as company_size,
               lower(c_mktsegment) as industry, r_name as region,
               case when c_acctbal < 2000 then 'free' when c_acctbal < 6500 then 'pro' else 'team' end as plan_type,
               first_order as signup_date,
               cast(case when c_acctbal < 2000 then 0 when c_acctbal < 6500 then 12 * (1 + c_custkey % 4)
                         else 60 + 30 * (c_custkey % 14) end as double) as monthly_revenue
        from customer left join nation on c_nationkey = n_nationkey
             left join region on n_regionkey = r_regionkey
             left join (select o_custkey, cast(min(o_orderdate) as date) as first_order from orders group by 1)
               on o_custkey = c_custkey""",
    "deals": """
        select o_orderkey as deal_id, o_custkey as account_id,
               ['website', 'referral', 'outbound', 'ads'][o_orderkey % 4 + 1] as lead_source,
               cast(o_orderdate as date) as created_date, o_totalprice as deal_value,
               coalesce(cast(floor(max_discount * 100 + 0.5) * 2 + 5 as integer), 0) as discount_pct,
               case left(o_orderpriority, 1) when '1' then 'Canva' when '2' then 'Adobe Express' when '3' then 'Figma'
                    when '4' then 'None' when '5' then 'Piktochart' end as competitor_mentioned,
               ['demo', 'proposal', 'negotiation'][o_orderkey % 3 + 1] as stage,
               cast(coalesce(last_ship, o_orderdate) as date) as close_date,
               case when o_orderstatus = 'F' then 'lost' else 'won' end as deal_status
        from orders left join (select l_orderkey, max(l_shipdate) as last_ship, max(l_discount) as max_discount
                               from lineitem group by 1) on l_orderkey = o_orderkey""",
    "product_usage": """
        select user_id as account_id, cast(date_trunc('week', ts) as date) as week_start,
               count(*) filter (event_type = 'click') as projects_created,
               count(*) filter (event_type = 'view') as templates_used,
               count(*) filter (event_type = 'signup') as ai_design_tool_usage,
               count(*) filter (event_type = 'purchase') as exports_count,
               count(*) filter (event_type = 'error') as collaboration_sessions,
               count(*) as weekly_active_users
        from events group by 1, 2""",
    "support_tickets": f"""
        select o_orderkey as ticket_id, o_custkey as account_id, cast(o_orderdate as date) as created_date,
               ['bug', 'billing', 'feature_request', 'performance_issue'][o_orderkey % 4 + 1] as ticket_type,
               case when left(o_orderpriority, 1) in ('1', '2') then 'high' when left(o_orderpriority, 1) = '3'
                    then 'medium' else 'low' end as priority,
               cast(1 + o_orderkey % 120 as integer) as resolution_hours,
               cast(1 + o_orderkey % 5 as integer) as csat_score,
               {_rule_text('o_orderkey', 'Ticket')} as ticket_summary
        from orders where o_orderstatus = 'P'""",
    "sales_notes": f"""
        select l_orderkey * 10 + l_linenumber as note_id, l_orderkey as deal_id, cast(l_shipdate as date) as note_date,
               {_rule_text('l_orderkey * 10 + l_linenumber', 'Call')} as note_text
        from lineitem""",
    "cancellations": f"""
        select l_orderkey * 10 + l_linenumber as cancellation_id, o_custkey as account_id,
               cast(l_shipdate as date) as cancellation_date, l_linenumber % 3 = 0 as refund_requested,
               {_rule_text('l_orderkey * 10 + l_linenumber', 'Exit')} as cancellation_reason_text,
               l_extendedprice as churned_revenue,
               ['low_usage', 'competitor_switch', 'pricing', 'performance']
                 [((l_orderkey + l_linenumber) % 12) // 3 + 1] as reason_type
        from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R'""",
    "rules": _values(
        (i, _text(r[0]), _text(r[1]), _text(k)) for i, r in enumerate(RULE_ROWS) for k in _keywords(r)
    ),
    "playbook": _values((_text(c), _text(a)) for c, a in ACTIONS),
    "best_note": """
        select deal_id, category, subcategory, confidence from (
            select *, row_number() over (partition by deal_id order by confidence desc, note_date, note_id,
                                         category, subcategory) as rn from notes_classified) where rn = 1""",
    "attributed": """
        select d.*,
               coalesce(b.category, case when discount_pct >= 20 then 'Commercial'
                   when competitor_mentioned <> 'None' then 'Competitive' end, 'Uncategorized') as deal_loss_category,
               coalesce(b.subcategory, case when discount_pct >= 20 then 'pricing_concerns'
                   when competitor_mentioned <> 'None' then 'competitor_switch' end, 'unclear_signal')
                   as deal_loss_subcategory,
               coalesce(b.confidence, 0.3::double) as deal_loss_confidence,
               deal_value * (1 - discount_pct / 100.0::double) as effective_deal_value
        from deals d left join best_note b on b.deal_id = d.deal_id""",
    "churn_by_cause": f"""
        select category, subcategory, count(cancellation_id) as source_records,
               {money('churned_revenue')} as lost_revenue, 'churn' as source
        from cancellations_classified group by category, subcategory""",
    "deals_by_cause": f"""
        select deal_loss_category as category, deal_loss_subcategory as subcategory, count(deal_id) as source_records,
               {money('effective_deal_value')} as lost_revenue, 'lost_deal' as source
        from attributed where deal_status = 'lost' group by 1, 2""",
    "by_cause": f"""
        select category, subcategory, source, source_records, {cents('lost_revenue')} as lost_revenue
        from (select * from churn_by_cause union all by name select * from deals_by_cause)""",
    "summary": f"""
        select category, subcategory, source, source_records, lost_revenue,
               case when sum(lost_revenue) over () > 0
                    then {cents('lost_revenue / sum(lost_revenue) over () * 100')}
                    else 0.0::double end as pct_of_total_loss
        from by_cause""",
    "churn_by_month": f"""
        select strftime(cancellation_date, '%Y-%m') as period, {money('churned_revenue')} as churn_revenue_lost,
               count(cancellation_id) as churn_events from cancellations group by 1""",
    "deals_by_month": f"""
        select strftime(close_date, '%Y-%m') as period, {money('deal_value * (1 - discount_pct / 100.0::double)')}
               as lost_deal_value, count(deal_id) as lost_deal_events
        from deals where deal_status = 'lost' group by 1""",
    "trend": """
        select coalesce(c.period, d.period) as period, coalesce(churn_revenue_lost, 0) as churn_revenue_lost,
               coalesce(churn_events, 0) as churn_events, coalesce(lost_deal_value, 0) as lost_deal_value,
               coalesce(lost_deal_events, 0) as lost_deal_events,
               coalesce(churn_revenue_lost, 0) + coalesce(lost_deal_value, 0) as total_revenue_loss
        from churn_by_month c full join deals_by_month d on c.period is not distinct from d.period""",
    "churn_by_segment": f"""
        select plan_type, region, industry, {money('churned_revenue')} as churn_revenue_lost,
               count(cancellation_id) as churn_events
        from cancellations left join accounts using (account_id) group by 1, 2, 3""",
    "deals_by_segment": f"""
        select plan_type, region, industry, {money('deal_value * (1 - discount_pct / 100.0::double)')}
               as lost_deal_value, count(deal_id) as lost_deal_events
        from deals left join accounts using (account_id) where deal_status = 'lost' group by 1, 2, 3""",
    "segments": """
        select coalesce(c.plan_type, d.plan_type) as plan_type, coalesce(c.region, d.region) as region,
               coalesce(c.industry, d.industry) as industry,
               coalesce(churn_revenue_lost, 0) as churn_revenue_lost, coalesce(churn_events, 0) as churn_events,
               coalesce(lost_deal_value, 0) as lost_deal_value, coalesce(lost_deal_events, 0) as lost_deal_events,
               coalesce(churn_revenue_lost, 0) + coalesce(lost_deal_value, 0) as total_revenue_loss
        from churn_by_segment c full join deals_by_segment d
          on c.plan_type is not distinct from d.plan_type and c.region is not distinct from d.region
         and c.industry is not distinct from d.industry""",
    "recommendations": """
        select cast(row_number() over (order by total_lost_revenue desc, category) as integer) as priority, category,
               total_lost_revenue, source_records,
               coalesce(action, (select action from playbook where category = 'Uncategorized')) as recommended_action
        from (select category, cast(sum(cast(lost_revenue as decimal(28,4))) as double) as total_lost_revenue,
                     cast(sum(source_records) as bigint) as source_records
              from summary where category is not null group by category
              order by total_lost_revenue desc, category limit 5)
        left join playbook using (category)""",
    "usage_means": """
        select account_id, avg(projects_created) as avg_projects_created, avg(templates_used) as avg_templates_used,
               avg(ai_design_tool_usage) as avg_ai_usage, avg(exports_count) as avg_exports,
               avg(collaboration_sessions) as avg_collaboration,
               avg(weekly_active_users) as avg_weekly_active_users
        from product_usage group by account_id""",
    "recent_usage": """
        select * from (select account_id, week_start, projects_created, weekly_active_users,
               row_number() over (partition by account_id order by week_start desc) as rn from product_usage)
        where rn <= 4""",
    "recent_means": """
        select account_id, avg(projects_created) as recent_projects_created,
               avg(weekly_active_users) as recent_weekly_active_users
        from recent_usage group by account_id""",
    "support_summary": """
        select account_id, count(ticket_id) as ticket_count, avg(resolution_hours) as avg_resolution_hours,
               avg(csat_score) as avg_csat,
               cast(sum(cast(priority = 'high' as integer)) as bigint) as high_priority_tickets,
               cast(sum(cast(ticket_type = 'performance_issue' as integer)) as bigint) as performance_tickets,
               cast(sum(cast(ticket_type = 'billing' as integer)) as bigint) as billing_tickets,
               cast(sum(cast(ticket_type = 'feature_request' as integer)) as bigint) as feature_request_tickets
        from support_tickets group by account_id""",
    "deal_summary": f"""
        select account_id, count(deal_id) as total_deals,
               cast(sum(cast(deal_status = 'lost' as integer)) as bigint) as lost_deals,
               avg(discount_pct) as avg_discount_pct, {money('deal_value')} / count(deal_value) as avg_deal_value,
               avg(cast(competitor_mentioned <> 'None' as integer)) as competitor_mention_rate,
               sum(cast(deal_status = 'lost' as integer)) / greatest(count(deal_id), 1)::double as lost_deal_rate
        from deals group by account_id""",
    "features": """
        select a.account_id, company_size, industry, region, plan_type, signup_date,
               coalesce(monthly_revenue, 0) as monthly_revenue,
               coalesce(avg_projects_created, 0) as avg_projects_created,
               coalesce(avg_templates_used, 0) as avg_templates_used, coalesce(avg_ai_usage, 0) as avg_ai_usage,
               coalesce(avg_exports, 0) as avg_exports, coalesce(avg_collaboration, 0) as avg_collaboration,
               coalesce(avg_weekly_active_users, 0) as avg_weekly_active_users,
               coalesce(recent_projects_created, 0) as recent_projects_created,
               coalesce(recent_weekly_active_users, 0) as recent_weekly_active_users,
               coalesce(ticket_count, 0) as ticket_count, coalesce(avg_resolution_hours, 0) as avg_resolution_hours,
               coalesce(avg_csat, 0) as avg_csat, coalesce(high_priority_tickets, 0) as high_priority_tickets,
               coalesce(performance_tickets, 0) as performance_tickets,
               coalesce(billing_tickets, 0) as billing_tickets,
               coalesce(feature_request_tickets, 0) as feature_request_tickets,
               coalesce(total_deals, 0) as total_deals, coalesce(lost_deals, 0) as lost_deals,
               coalesce(avg_discount_pct, 0) as avg_discount_pct, coalesce(avg_deal_value, 0) as avg_deal_value,
               coalesce(competitor_mention_rate, 0) as competitor_mention_rate,
               coalesce(lost_deal_rate, 0) as lost_deal_rate,
               coalesce(greatest(datediff('day', signup_date, date '2026-03-12'), 0), 0) as account_age_days,
               cast(account_id in (select account_id from cancellations) as integer) as is_churned
        from accounts a left join usage_means using (account_id) left join recent_means using (account_id)
             left join support_summary using (account_id) left join deal_summary using (account_id)""",
    "churn_scores": """
        select a.*, coalesce(avg_projects_created, 0) as avg_projects_created,
               coalesce(avg_weekly_active_users, 0) as avg_weekly_active_users,
               case when monthly_revenue > 0 then (
                   case plan_type when 'free' then 0 when 'pro' then 11 else 14 end
                   + case when coalesce(avg_projects_created, 0) < 2 then 10 else 0 end
                   + case when coalesce(avg_weekly_active_users, 0) < 2 then 8 else 0 end
                   - case when monthly_revenue >= 180 then 3 else 0 end) / 100.0::double
               else 0.0::double end as churn_probability,
               cast(account_id in (select account_id from cancellations) as integer) as churned
        from accounts a left join usage_means using (account_id)""",
    "risk": f"""
        select account_id, monthly_revenue, plan_type, region, industry, churn_probability,
               case when churn_probability > -0.01 and churn_probability <= 0.25 then 'Low'
                    when churn_probability > 0.25 and churn_probability <= 0.5 then 'Medium'
                    when churn_probability > 0.5 and churn_probability <= 0.75 then 'High'
                    when churn_probability > 0.75 and churn_probability <= 1 then 'Critical' end as risk_tier,
               {cents('monthly_revenue * churn_probability')} as estimated_monthly_revenue_at_risk
        from churn_scores""",
    "win_scores": """
        select d.*, company_size, win_points / 100.0::double as win_probability,
               win_points / 100.0::double * (deal_value * (1 - discount_pct / 100.0::double)) as expected_value
        from (select d.*, company_size, 58 - case when competitor_mentioned <> 'None' then 12 else 0 end
                     - case when discount_pct >= 20 then 5 else 0 end
                     + case when lead_source = 'referral' then 10 else 0 end
                     - case when company_size = 'mid_market' then 8 else 0 end as win_points
              from deals d left join accounts using (account_id)) d""",
    "curve": """
        select score, positives, negatives, tp, fp, tp / (tp + fp)::double as "precision",
               tp / P::double as recall, 2.0::double * tp / (tp + fp + P) as f1, P, N
        from (select score, positives, negatives,
                     cast(sum(positives) over (order by score desc) as bigint) as tp,
                     cast(sum(negatives) over (order by score desc) as bigint) as fp,
                     sum(positives) over () as P, sum(negatives) over () as N
              from (select churn_probability as score, count(*) filter (churned = 1) as positives,
                           count(*) filter (churned = 0) as negatives from churn_scores group by 1))""",
    "account_usage": """
        select a.*, projects_created, templates_used, ai_design_tool_usage, exports_count, collaboration_sessions,
               weekly_active_users, cast(account_id in (select account_id from cancellations) as integer) as churned
        from accounts a left join (
            select account_id, avg(projects_created) as projects_created, avg(templates_used) as templates_used,
                   avg(ai_design_tool_usage) as ai_design_tool_usage, avg(exports_count) as exports_count,
                   avg(collaboration_sessions) as collaboration_sessions,
                   avg(weekly_active_users) as weekly_active_users from product_usage group by 1) using (account_id)""",
    "metrics": """
        select (select sum((2 * tp - positives)::hugeint * negatives)::double / (2.0::double * max(P)::double
                       * max(N)::double) from curve) as roc_auc,
               (select cast(sum(cast(positives::double * tp / (tp + fp) as decimal(30,12))) as double)
                       / max(P)::double from curve) as pr_auc,
               (tp + N - fp) / (P + N)::double as accuracy, recall, f1, score as optimal_threshold,
               P / (P + N)::double as positive_rate
        from curve order by f1 desc, score limit 1""",
}

COLUMN_NAMES = {
    "rules": "(rule_no, category, subcategory, keyword)",
    "playbook": "(category, action)",
}


def classified(table: str, text: str) -> str:
    """Rows of ``table`` with the winning rule, found by joining texts to keywords."""
    return f"""
        select t.*, coalesce(b.category, 'Uncategorized') as category,
               coalesce(b.subcategory, 'unclear_signal') as subcategory, coalesce(b.terms, '') as matched_terms,
               case when b.hits is not null then least(0.95::double, (5 + b.hits) / 10.0::double)
                    when {text} is null or not regexp_matches({text}, '\\S') then 0.1::double
                    else 0.25::double end as confidence
        from {table} t left join (
            select * from (
                select txt, category, subcategory, count(*) as hits,
                       string_agg(keyword, ', ' order by keyword) as terms,
                       row_number() over (partition by txt order by count(*) desc, rule_no) as rn
                from (select distinct {text} as txt from {table}) join rules on contains(lower(txt), keyword)
                group by txt, rule_no, category, subcategory)
            where rn = 1) b on b.txt = t.{text}"""


VIEWS["notes_classified"] = classified("sales_notes", "note_text")
VIEWS["tickets_classified"] = classified("support_tickets", "ticket_summary")
VIEWS["cancellations_classified"] = classified("cancellations", "cancellation_reason_text")
VIEWS["documents_classified"] = classified("documents", "text")


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names, each after the views it names itself."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"\w+", re.sub(r"'[^']*'", " ", text)))
        for name in VIEWS:
            if name in words and name not in ordered:
                visit(VIEWS[name])
                ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    prefix = "with " + ",\n".join(f"{n}{COLUMN_NAMES.get(n, '')} as ({VIEWS[n]})" for n in ordered)
    # A query with views of its own continues the list.
    own = sql.lstrip()
    return f"{prefix},\n{own[len('with '):]}" if own.startswith("with ") else f"{prefix}\n{own}"
