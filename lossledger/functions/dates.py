"""Calendar expressions: reporting month, account age, tenure."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from lossledger.functions.numbers import clamp_low


def month_of(day: Column) -> Column:
    """Month as ``yyyy-MM``; a null day stays a null month."""
    return F.date_format(day, "yyyy-MM")


def days_until(as_of: dt.date, day: Column) -> Column:
    """Whole days from ``day`` to ``as_of``, never below zero."""
    return clamp_low(F.datediff(F.lit(as_of), day), 0)


def tenure_months(ended: Column, started: Column) -> Column:
    """Full 30-day months between two days, at least one."""
    return clamp_low((F.datediff(ended, started) / 30).cast("int"), 1)
