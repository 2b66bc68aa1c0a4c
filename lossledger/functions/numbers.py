"""Rounding, exact money sums and guarded ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Prices carry two decimals and percentages are whole, so a discounted value needs four.
MONEY = DecimalType(18, 4)


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Scale, round to the nearest integer with ties to even, scale back.

    This is how array libraries round doubles, so reported figures agree with theirs; Spark's
    own ``round`` breaks ties away from zero.
    """
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def as_money(value: Column) -> Column:
    return value.cast(MONEY)


def money_sum(value: Column) -> Column:
    """Sum that does not depend on the order in which tasks deliver their rows."""
    return F.sum(as_money(value)).cast("double")


def money_mean(value: Column) -> Column:
    """Mean over non-null values, from the order-independent sum; null for no values."""
    return F.sum(as_money(value)).cast("double") / F.nullif(F.count(value), F.lit(0))


def ratio(numerator: Column, denominator: Column, otherwise: float | None = None) -> Column:
    """Division that yields ``otherwise`` when the denominator is zero or null."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(otherwise).cast("double"))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is null."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def clamp_low(value: Column, floor: float) -> Column:
    """Lower bound that keeps nulls null (``greatest`` alone would skip them)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))


def exact_mean(value: Column, decimals: int = 9) -> Column:
    """Mean of a fractional column that does not depend on the order of its rows."""
    total = F.sum(value.cast(DecimalType(20, decimals))).cast("double")
    return total / F.nullif(F.count(value), F.lit(0))
