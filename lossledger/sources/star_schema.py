"""The business tables as views over an order/lineitem/event star schema.

Lets every operator run on data of that shape. Keys stay whole numbers; text columns are put together
from keywords of the rules by key, because the star schema has no sales or support prose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.functions.dates import tenure_months
from lossledger.functions.text import sql_text
from lossledger.operators.lookups import lookup_join
from lossledger.operators.taxonomy import RULES
from lossledger.sources.tables import Tables

TICKET_TYPES = ("bug", "billing", "feature_request", "performance_issue")
LEAD_SOURCES = ("website", "referral", "outbound", "ads")
STAGES = ("demo", "proposal", "negotiation")
REASON_TYPES = ("low_usage", "competitor_switch", "pricing", "performance")
COMPETITOR_BY_PRIORITY = {"1": "Canva", "2": "Adobe Express", "3": "Figma", "4": "None", "5": "Piktochart"}


def _pick(values: Sequence[str], number: Column) -> Column:
    listed = F.expr(f"array({', '.join(map(sql_text, values))})")
    return F.element_at(listed, (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def rule_text(number: Column, topic: str) -> Column:
    """A text about ``topic`` for a whole number: one to five keywords of two rules in turn.

    Of every 41 numbers one gives an empty text, one a blank one and one a text without keywords;
    two rules with the same number of hits tie.
    """
    keywords = F.expr("array(" + ", ".join(f"array({', '.join(map(sql_text, r.keywords))})" for r in RULES) + ")")
    step = F.floor(number / 7)
    first = F.get(keywords, F.pmod(step, F.lit(len(RULES))).cast("int"))
    second = F.get(keywords, F.pmod(F.floor(step / 11) + 3 * number, F.lit(len(RULES))).cast("int"))

    def word(i: int) -> Column:
        rule = second if i % 2 else first
        return F.get(rule, F.pmod(F.floor(number / 5) + i // 2, F.size(rule)).cast("int"))

    # Five terms, of which missing ones are skipped: no array is built for a text.
    words = F.concat_ws(" and ", *(F.when(F.pmod(number, F.lit(5)) >= i, word(i)) for i in range(5)))
    told = F.concat(F.lit(f"{topic} {{"), (number % 97).cast("string"), F.lit("}: "), words, F.lit("."))
    kind = F.pmod(number, F.lit(41))
    return (F.when(kind == 0, "").when(kind == 1, "   ")
            .when(kind == 2, F.concat(F.lit(f"{topic}: nothing new on day "), (number % 97).cast("string"))).otherwise(told))


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the star schema."""
    return spark.read.parquet(f"{path}/{table}.parquet")


def accounts(spark: SparkSession, path: str) -> DataFrame:
    # 25 nations and 5 regions, whatever the scale
    nations = F.broadcast(_read(spark, path, "nation").join(
        F.broadcast(_read(spark, path, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    ))
    first_order = (
        _read(spark, path, "orders")
        .groupBy(F.col("o_custkey").alias("account_id"))
        .agg(F.min("o_orderdate").cast("date").alias("signup_date"))
    )
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    plan = F.when(balance < 2000, "free").when(balance < 6500, "pro").otherwise("team")
    size = (
        F.when(key % 20 < 7, "solo").when(key % 20 < 16, "small_business").otherwise("mid_market")
    )
    revenue = (
        F.when(plan == "free", 0).when(plan == "pro", 12 * (1 + key % 4)).otherwise(60 + 30 * (key % 14))
    ).cast("double")
    return (
        _read(spark, path, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            key.alias("account_id"),
            size.alias("company_size"),
            F.lower("c_mktsegment").alias("industry"),
            F.col("r_name").alias("region"),
            plan.alias("plan_type"),
            revenue.alias("monthly_revenue"),
        )
        .join(first_order, "account_id", "left")
        .select(
            "account_id", "company_size", "industry", "region", "plan_type", "signup_date", "monthly_revenue"
        )
    )


LOST = "F"  # the stored status of an order that counts as a lost deal


def lost_deal_ids(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "orders").where(F.col("o_orderstatus") == LOST).select(F.col("o_orderkey").alias("deal_id"))


def deals(spark: SparkSession, path: str, *, lost_only: bool = False) -> DataFrame:
    """``lost_only`` filters by the stored status, which reaches the scan; one on the derived status would not."""
    orders = _read(spark, path, "orders")
    if lost_only:
        orders = orders.where(F.col("o_orderstatus") == LOST)
    shipped = (
        _read(spark, path, "lineitem")
        .groupBy(F.col("l_orderkey").alias("deal_id"))
        .agg(F.max("l_shipdate").alias("_shipped"), F.max("l_discount").alias("_discount"))
    )
    key = F.col("deal_id")
    competitor = F.create_map(*(F.lit(x) for item in COMPETITOR_BY_PRIORITY.items() for x in item))
    return (
        orders
        .withColumnRenamed("o_orderkey", "deal_id")
        .join(shipped, "deal_id", "left")
        .select(
            "deal_id",
            F.col("o_custkey").alias("account_id"),
            _pick(LEAD_SOURCES, key).alias("lead_source"),
            F.col("o_orderdate").cast("date").alias("created_date"),
            F.col("o_totalprice").alias("deal_value"),
            F.coalesce((F.floor(F.col("_discount") * 100 + 0.5) * 2 + 5).cast("int"), F.lit(0)).alias("discount_pct"),
            competitor[F.substring("o_orderpriority", 1, 1)].alias("competitor_mentioned"),
            _pick(STAGES, key).alias("stage"),
            F.coalesce("_shipped", "o_orderdate").cast("date").alias("close_date"),
            F.when(F.col("o_orderstatus") == LOST, "lost").otherwise("won").alias("deal_status"),
        )
    )


def product_usage(spark: SparkSession, path: str) -> DataFrame:
    def events(kind: str) -> Column:
        return F.count_if(F.col("event_type") == kind).cast("int")

    return (
        _read(spark, path, "events")
        .groupBy(
            F.col("user_id").alias("account_id"), F.date_trunc("week", "ts").cast("date").alias("week_start")
        )
        .agg(
            events("click").alias("projects_created"),
            events("view").alias("templates_used"),
            events("signup").alias("ai_design_tool_usage"),
            events("purchase").alias("exports_count"),
            events("error").alias("collaboration_sessions"),
            F.count(F.lit(1)).cast("int").alias("weekly_active_users"),
        )
    )


def support_tickets(spark: SparkSession, path: str) -> DataFrame:
    key = F.col("o_orderkey")
    rank = F.substring("o_orderpriority", 1, 1)
    return (
        _read(spark, path, "orders")
        .where(F.col("o_orderstatus") == "P")
        .select(
            key.alias("ticket_id"),
            F.col("o_custkey").alias("account_id"),
            F.col("o_orderdate").cast("date").alias("created_date"),
            _pick(TICKET_TYPES, key).alias("ticket_type"),
            F.when(rank <= "2", "high").when(rank == "3", "medium").otherwise("low").alias("priority"),
            (1 + key % 120).cast("int").alias("resolution_hours"),
            (1 + key % 5).cast("int").alias("csat_score"),
            rule_text(key, "Ticket").alias("ticket_summary"),
        )
    )


def notes_without_text(spark: SparkSession, path: str) -> DataFrame:
    key = F.col("l_orderkey")
    return _read(spark, path, "lineitem").select(
        (key * 10 + F.col("l_linenumber")).alias("note_id"),
        key.alias("deal_id"),
        F.col("l_shipdate").cast("date").alias("note_date"),
    )


def with_note_text(notes: DataFrame) -> DataFrame:
    """The text of a note follows from its id."""
    return notes.withColumn("note_text", rule_text(F.col("note_id"), "Call"))


def sales_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes without their account, which only the deal knows."""
    return with_note_text(notes_without_text(spark, path))


def with_account(spark: SparkSession, path: str, notes: DataFrame) -> DataFrame:
    owners = _read(spark, path, "orders").select(
        F.col("o_orderkey").alias("deal_id"), F.col("o_custkey").alias("account_id")
    )
    return notes.join(owners, "deal_id")


def sales_notes_with_account(spark: SparkSession, path: str) -> DataFrame:
    return with_account(spark, path, sales_notes(spark, path)).select(
        "note_id", "deal_id", "account_id", "note_date", "note_text"
    )


def cancellations(spark: SparkSession, path: str) -> DataFrame:
    owners = _read(spark, path, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("account_id")
    )
    text_no = F.col("l_orderkey") + F.col("l_linenumber")
    return (
        _read(spark, path, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .join(owners, "l_orderkey")
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cancellation_id"),
            "account_id",
            F.col("l_shipdate").cast("date").alias("cancellation_date"),
            (F.col("l_linenumber") % 3 == 0).alias("refund_requested"),
            rule_text(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "Exit").alias("cancellation_reason_text"),
            F.col("l_extendedprice").alias("churned_revenue"),
            _pick(REASON_TYPES, F.floor(F.pmod(text_no, F.lit(12)) / 3)).alias("reason_type"),
        )
    )


def with_tenure(cancelled: DataFrame, owners: DataFrame) -> DataFrame:
    """Cancellations with the age of the account when it left."""
    dated = lookup_join(cancelled, owners.select("account_id", "signup_date"), "account_id", "cancellation_id")
    tenure = tenure_months(F.col("cancellation_date"), F.col("signup_date"))
    return dated.withColumn("tenure_months", tenure).drop("signup_date")


def star_tables(spark: SparkSession, path: str) -> Tables:
    return Tables(
        accounts=accounts(spark, path),
        deals=deals(spark, path),
        usage=product_usage(spark, path),
        support=support_tickets(spark, path),
        notes=sales_notes(spark, path),
        cancellations=cancellations(spark, path),
    )
