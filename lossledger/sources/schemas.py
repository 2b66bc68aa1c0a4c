"""Declared schemas of the six business tables; nothing is inferred from data."""

from __future__ import annotations

# Column names and types of the business tables.
SCHEMAS: dict[str, str] = {
    "accounts": """
        account_id string, company_size string, industry string, region string,
        plan_type string, signup_date date, monthly_revenue double""",
    "deals": """
        deal_id string, account_id string, lead_source string, created_date date,
        deal_value double, discount_pct int, competitor_mentioned string, stage string,
        close_date date, deal_status string""",
    "product_usage": """
        account_id string, week_start date, projects_created int, templates_used int,
        ai_design_tool_usage int, exports_count int, collaboration_sessions int,
        weekly_active_users int""",
    "support_tickets": """
        ticket_id string, account_id string, created_date date, ticket_type string,
        priority string, resolution_hours int, csat_score int, ticket_summary string,
        account_revenue double""",
    "sales_notes": """
        note_id string, deal_id string, account_id string, note_date date, note_text string""",
    "cancellations": """
        cancellation_id string, account_id string, cancellation_date date, tenure_months int,
        refund_requested boolean, cancellation_reason_text string, churned_revenue double,
        reason_type string""",
}
