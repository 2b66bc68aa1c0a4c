"""Exact running sums in sort order, over groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import staged


def running(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, str]) -> DataFrame:
    """``df`` with ``{name: sum of column over the earlier rows of the group}``; 0 for the first row.

    Rows are cut into ranges of (``group``, ``order``), as many as the session has shuffle partitions,
    and stored. A row's sum is that of its own range plus the totals of the group's earlier ranges. Only
    groups that cross a cut have such totals, so these are fewer rows than ranges and are broadcast; a
    group that holds most of the rows is spread over as many tasks. ``order`` should be a total order, for
    equal rows share a range. Columns that begin with ``_range`` are taken.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(c).asc_nulls_last() for c in group), *order]
    cut = staged(df.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*group, "_range").agg(*(F.sum(c).alias(n) for n, c in sums.items())).select(
        *(F.col(c).alias(f"_range_{i}") for i, c in enumerate(group)), F.col("_range").alias("_range_of"),
        *(F.sum(n).over(earlier).alias(f"_range_{n}") for n in sums), F.count(F.lit(1)).over(earlier).alias("_ranges_before"),
    ).where("_ranges_before > 0").drop("_ranges_before")
    same = F.col("_range") == F.col("_range_of")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_range_{i}"))
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0)
    return cut.withColumns({n: F.coalesce(F.sum(c).over(within), nothing) for n, c in sums.items()}).join(
        F.broadcast(starts), same, "left").select(
        *df.columns, *((F.col(n) + F.coalesce(F.col(f"_range_{n}"), nothing)).alias(n) for n in sums))
