"""Running totals over a whole table in sort order, without a single-partition window."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_BUCKETS = 256  # ranges, also in small sessions


HASHES = 1 << 40  # values of the hash that picks cut points


def default_buckets(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions, so that ranges shrink as a cluster
    grows. More ranges only make them smaller; every row is in one."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_BUCKETS, partitions)


def with_sort_bucket(df: DataFrame, key: str, name: str, buckets: int) -> DataFrame:
    """Number each row so that the numbers follow the order of ``key``.

    The cut points are the keys whose hash falls below a share of the hash range, ``buckets - 1``
    of them on average: a uniform sample of the distinct keys that depends on the data alone, so
    every evaluation agrees on it. It is a filter, so no task ranks keys, and the cut points that
    meet in one row are about as many as the ranges.
    """
    share = df.agg((F.lit(float(buckets - 1)) / F.greatest(F.count(F.lit(1)), F.lit(1)) * HASHES).alias("share")).scalar()
    sample = df.where(F.pmod(F.xxhash64(key), F.lit(HASHES)) < share)
    cuts = sample.agg(F.array_sort(F.collect_list(key))).scalar()
    placed = df.withColumns({"_cuts": cuts, name: F.lit(0)})
    # Binary search, one projection per halving; reading past the last cut gives null.
    # Twice as many cuts as expected, and 64 more, is beyond any chance; later cuts would only stay unused.
    step = 1 << (2 * buckets + 64).bit_length() - 1
    while step:
        passed = F.get("_cuts", F.col(name) + (step - 1)) <= F.col(key)
        placed = placed.withColumn(name, F.col(name) + F.when(passed, step).otherwise(0))
        step //= 2
    return placed.drop("_cuts")


def running_totals(
    df: DataFrame,
    key: str,
    totals: Mapping[str, str],
    *,
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Append ``{name: running total of column}`` in the order of ``key``.

    ``df`` has one row per distinct, non-null key and is read three times, so it should be a
    stored table. Rows are cut into ranges of the key, each range is summed, and a range's rows
    start from the total of the ranges before it. Only the range totals (at most ``buckets``
    rows) are ordered in one place and broadcast.
    """
    buckets = buckets or default_buckets(df)
    measured = list(totals.values())
    ranged = with_sort_bucket(df, key, "_range", buckets)

    def direction(name: str) -> Column:
        return F.desc(name) if descending else F.asc(name)

    before = Window.orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_range")
        .agg(*(F.sum(m).alias(m) for m in measured))
        .select("_range", *(F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_start_{m}") for m in measured))
    )
    within = (
        Window.partitionBy("_range").orderBy(direction(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranged.join(F.broadcast(starts), "_range")
        .withColumns({name: F.col(f"_start_{m}") + F.sum(m).over(within) for name, m in totals.items()})
        .select(*df.columns, *totals)
    )
