"""Risk tiers, revenue at risk, and scores from plain business rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.functions.numbers import round_half_even
from lossledger.operators.attribution import HEAVY_DISCOUNT, effective_value, mentions_competitor
from lossledger.operators.features import usage_means
from lossledger.operators.lookups import lookup_join

# Upper bound (inclusive) and name of each risk tier; scores start above -0.01.
TIER_FLOOR = -0.01
TIERS = ((0.25, "Low"), (0.5, "Medium"), (0.75, "High"), (1.0, "Critical"))

# Account columns a score table needs besides the probability.
SCORE_INPUTS = ("account_id", "monthly_revenue", "plan_type", "region", "industry")


def risk_tier(probability: Column) -> Column:
    """Tier of a probability; each tier includes its upper bound, and anything outside is null."""
    tier = F.when(probability <= TIER_FLOOR, F.lit(None))
    for upper, name in TIERS:
        tier = tier.when(probability <= upper, F.lit(name))
    return tier


def revenue_at_risk(monthly_revenue: Column, probability: Column) -> Column:
    return round_half_even(monthly_revenue * probability)


def by_risk(df: DataFrame) -> DataFrame:
    """Most revenue at risk first, then most likely to leave, then by id."""
    return df.orderBy(F.desc("estimated_monthly_revenue_at_risk"), F.desc("churn_probability"), "account_id")


def score_table(scored: DataFrame, probability: str = "churn_probability", *, ordered: bool = True) -> DataFrame:
    """Account scores with tier and revenue at risk, from any table with a probability.

    Most revenue at risk comes first; ``ordered=False`` spares the global sort of all accounts.
    """
    p = F.col(probability)
    table = scored.select(
        *SCORE_INPUTS,
        p.alias("churn_probability"),
        risk_tier(p).alias("risk_tier"),
        revenue_at_risk(F.col("monthly_revenue"), p).alias("estimated_monthly_revenue_at_risk"),
    )
    return by_risk(table) if ordered else table


def _points(*terms: Column | int) -> Column:
    """Percentage points add up as whole numbers, so equal rules give exactly equal scores."""
    total = F.lit(0)
    for term in terms:
        total = total + term
    return total / 100.0


def _award(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def rule_churn_propensity(accounts: DataFrame, usage: DataFrame) -> DataFrame:
    """Accounts with a churn propensity from plan, engagement and revenue; 0 without revenue."""
    engaged = usage_means(usage).select("account_id", "avg_projects_created", "avg_weekly_active_users")
    joined = accounts.join(engaged, "account_id", "left").na.fill(
        0, ["avg_projects_created", "avg_weekly_active_users"]
    )
    # Points per condition.
    base = F.when(F.col("plan_type") == "free", 0).when(F.col("plan_type") == "pro", 6 + 5).otherwise(6 + 8)
    score = _points(
        base,
        _award(F.col("avg_projects_created") < 2, 10),
        _award(F.col("avg_weekly_active_users") < 2, 8),
        _award(F.col("monthly_revenue") >= 180, -3),
    )
    return joined.withColumn(
        "churn_probability", F.when(F.col("monthly_revenue") > 0, score).otherwise(0.0)
    )


def rule_win_propensity(deals: DataFrame, accounts: DataFrame) -> DataFrame:
    """Deals with a win propensity and the expected value it gives the discounted deal."""
    sized = lookup_join(deals, accounts.select("account_id", "company_size"), "account_id", "deal_id")
    # Points per condition.
    score = _points(
        58,
        _award(mentions_competitor(F.col("competitor_mentioned")), -12),
        _award(F.col("discount_pct") >= HEAVY_DISCOUNT, -5),
        _award(F.col("lead_source") == "referral", 10),
        _award(F.col("company_size") == "mid_market", -8),
    )
    value = effective_value(F.col("deal_value"), F.col("discount_pct"))
    return sized.withColumns({"win_probability": score, "expected_value": score * value})
