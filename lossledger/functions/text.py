"""Text expressions: blank test, segment labels, metric labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character counted as white space when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Display names of the trend measures.
METRIC_LABELS = {
    "churn_revenue_lost": "Churn Revenue Lost",
    "lost_deal_value": "Lost Deal Value",
    "total_revenue_loss": "Total Revenue Loss",
}


def is_blank(text: Column) -> Column:
    """Null, empty or white space only. Trimming the left side stops at the first other
    character; no regular expression is run over the text."""
    return text.isNull() | (F.ltrim(text, F.lit(WHITESPACE)) == "")


def lookup_label(name: Column, labels: dict[str, str] = METRIC_LABELS) -> Column:
    """Display name of a metric, or the metric itself where none is known."""
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def segment_label(*parts: Column, null_text: str = "nan") -> Column:
    """The parts joined by space-bar-space; a missing part shows as ``null_text``."""
    return F.concat_ws(" | ", *(F.coalesce(p.cast("string"), F.lit(null_text)) for p in parts))


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
