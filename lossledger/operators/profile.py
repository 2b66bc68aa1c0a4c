"""Exploratory profiles: missing values, frequencies, distribution, grouped means."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from lossledger.functions.numbers import exact_mean, flag, money_sum
from lossledger.operators.cumulative import running_totals
from lossledger.operators.features import USAGE_MEANS, churn_labels
from lossledger.session import stage


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """Missing values per column as (table_name, column_name, nulls); one pass over the table."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counts.unpivot([], df.columns, "column_name", "nulls").select(
        F.lit(table).alias("table_name"), "column_name", "nulls"
    )


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """How often each value occurs, most frequent first."""
    kept = df.where(F.col(column).isNotNull()) if dropna else df
    counted = kept.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("occurrences"))
    return counted.orderBy(F.desc("occurrences"), "value")


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each column, the mean of the middle two for an even count; null without values.

    Nulls and NaN do not count. All columns are ranked together: values collapse to one row per
    column and value, and running totals over both give the ranks. One row per column is collected.
    """
    pairs = F.array(*(F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)))
    counts = stage(
        df.select(F.explode(pairs).alias("key"))
        .where(F.col("key.value").isNotNull() & ~F.isnan("key.value"))
        .groupBy("key").agg(F.count(F.lit(1)).alias("occurrences"))
    )
    ranked = running_totals(counts, "key", {"upto": "occurrences"}).select(
        F.col("key.column").alias("column"), F.col("key.value").alias("value"), "upto", "occurrences")
    sizes = ranked.groupBy("column").agg(F.sum("occurrences").alias("n"), F.max("upto").alias("end"))
    middle = (F.col("end") - F.col("n") + F.floor((F.col("n") - 1) / 2), F.col("end") - F.col("n") + F.ceil((F.col("n") - 1) / 2))
    reaches = [(F.col("upto") - F.col("occurrences") <= rank) & (rank < F.col("upto")) for rank in middle]
    found = ranked.join(F.broadcast(sizes), "column").groupBy("column").agg(
        *(F.max(F.when(reached, F.col("value"))).alias(name) for reached, name in zip(reaches, ("low", "high"))))
    values = {row["column"]: row["low"] + (row["high"] - row["low"]) * 0.5 for row in found.collect()}
    return {c: values.get(i) for i, c in enumerate(columns)}


def quantiles(df: DataFrame, column: str, fractions: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per fraction.

    Values collapse to one row each with their frequency, which is stored; running totals give
    every value its ranks, and a quantile reads the values at the two ranks around it. Nothing
    is collected.
    """
    value = F.col(column).cast("double")
    counts = stage(
        df.where(F.col(column).isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("occurrences"))
    )
    ranked = running_totals(counts, "value", {"upto": "occurrences"})
    total = counts.agg(F.sum("occurrences")).scalar()
    located = ranked.withColumn("_n", total)

    def position(q: float) -> Column:
        return F.lit(float(q)) * (F.col("_n") - 1)

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("occurrences") <= rank) & (rank < F.col("upto")), F.col("value")))

    picked = located.agg(
        *(value_at(F.floor(position(q))).alias(f"lo{i}") for i, q in enumerate(fractions)),
        *(value_at(F.ceil(position(q))).alias(f"hi{i}") for i, q in enumerate(fractions)),
        F.max("_n").alias("_n"),
    )
    rows = [
        F.struct(
            F.lit(float(q)).alias("fraction"),
            (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (position(q) - F.floor(position(q)))).alias("value"),
        )
        for i, q in enumerate(fractions)
    ]
    return picked.select(F.explode(F.array(*rows)).alias("q")).select("q.fraction", "q.value")


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a column, as (statistic, value) rows."""
    value = F.col(column).cast("double")
    basic = df.agg(
        F.count(value).cast("double").alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ).unpivot([], ["count", "mean", "std", "min", "max"], "statistic", "value")
    quartiles = quantiles(df, column, (0.25, 0.5, 0.75)).select(
        F.concat((F.col("fraction") * 100).cast("int"), F.lit("%")).alias("statistic"), "value"
    )
    return basic.unionByName(quartiles)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram as (bin, lower, upper, occurrences), empty bins included.

    The last bin includes its upper edge. A column with a single value gets bins of width
    ``1 / bins`` around it.
    """
    present = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    span = present.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    flat = span["lo"] == span["hi"]
    low = F.when(flat, span["lo"] - 0.5).otherwise(span["lo"])
    width = F.when(flat, 1.0 / bins).otherwise((span["hi"] - span["lo"]) / bins)
    guess = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1))
    # The division can land one bin off next to an edge; the edges decide.
    below = (F.col("x") < low + F.col("guess") * width).cast("int")
    above = ((F.col("x") >= low + (F.col("guess") + 1) * width) & (F.col("guess") < bins - 1)).cast("int")
    numbers = present.withColumn("guess", guess).select(
        (F.col("guess") - below + above).alias("bin"), F.lit(1).alias("n")
    )
    every_bin = df.sparkSession.range(bins).select(F.col("id").alias("bin"), F.lit(0).alias("n"))
    counted = numbers.unionByName(every_bin).groupBy("bin").agg(F.sum("n").alias("occurrences"))
    return counted.select(
        F.col("bin").cast("int").alias("bin"),
        (low + F.col("bin") * width).alias("lower"),
        (low + (F.col("bin") + 1) * width).alias("upper"),
        "occurrences",
    ).orderBy("bin")


def mean_by(df: DataFrame, key: str, *measures: str, by: str | None = None) -> DataFrame:
    """Means per key in the order of the mean of ``by`` (else of the key); rows without a key are left out."""
    fractional = {f.name for f in df.schema.fields if isinstance(f.dataType, FractionalType)}
    means = ((exact_mean(F.col(m)) if m in fractional else F.avg(m)).alias(m) for m in measures)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*means).orderBy(*([by] if by else []), key)


def churn_overview(cancellations: DataFrame) -> DataFrame:
    """Cancellations and churned revenue per reason, and over all of them, in one pass.

    The row over all has the reason ``all`` and counts rows without a reason too; those have no row
    of their own.
    """
    rolled = cancellations.rollup("reason_type").agg(
        F.grouping("reason_type").alias("_all"),
        F.count(F.lit(1)).alias("cancellations"),
        money_sum(F.col("churned_revenue")).alias("churned_revenue"),
    )
    reason = F.when(F.col("_all") == 1, "all").otherwise(F.col("reason_type"))
    kept = rolled.where((F.col("_all") == 1) | F.col("reason_type").isNotNull())
    return kept.orderBy("churned_revenue").select(reason.alias("reason_type"), "cancellations", "churned_revenue")


def win_rate_by_competitor(deals: DataFrame) -> DataFrame:
    won = flag(F.col("deal_status") == "won")
    rates = (
        deals.where(F.col("competitor_mentioned").isNotNull())
        .groupBy("competitor_mentioned")
        .agg(F.avg(won).alias("win_rate"))
    )
    return rates.orderBy("win_rate", "competitor_mentioned")


def account_usage(accounts: DataFrame, usage: DataFrame) -> DataFrame:
    """Accounts with their mean weekly usage; null where an account has none."""
    means = usage.groupBy("account_id").agg(*(F.avg(m).alias(m) for m in USAGE_MEANS))
    return accounts.join(means, "account_id", "left")


def with_churned(df: DataFrame, cancellations: DataFrame) -> DataFrame:
    """1 for accounts that appear among the cancellations, else 0."""
    left = churn_labels(cancellations).select("account_id", F.lit(1).alias("churned"))
    return df.join(left, "account_id", "left").withColumn("churned", F.coalesce("churned", F.lit(0)))


TICKET_MEASURES = ("ticket_id", "resolution_hours", "csat_score")


def ticket_aggregates() -> list[Column]:
    return [
        F.count("ticket_id").alias("ticket_count"),
        F.avg("resolution_hours").alias("avg_resolution_hours"),
        F.avg("csat_score").alias("avg_csat"),
    ]


def ticket_summary(support: DataFrame) -> DataFrame:
    return support.groupBy("account_id").agg(*ticket_aggregates())


def account_health(accounts: DataFrame, usage: DataFrame, support: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Accounts with usage means, churn flag and ticket summary; no tickets counts as 0.

    The three sources are aggregated together, so the accounts are joined once.
    """
    rows = (
        usage.select("account_id", *USAGE_MEANS)
        .unionByName(support.select("account_id", *TICKET_MEASURES), allowMissingColumns=True)
        .unionByName(cancellations.select("account_id", F.lit(1).alias("churned")), allowMissingColumns=True)
    )
    activity = rows.groupBy("account_id").agg(
        *(F.avg(m).alias(m) for m in USAGE_MEANS), *ticket_aggregates(), F.max("churned").alias("churned")
    )
    return accounts.join(activity, "account_id", "left").na.fill(
        0, ["ticket_count", "avg_resolution_hours", "avg_csat", "churned"]
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def shape(df: DataFrame, table: str) -> DataFrame:
    """Number of rows and columns of a table."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(table).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count")
    )
