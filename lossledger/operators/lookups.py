"""Left join of a large table to a table with one row per key, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, spread_by: str) -> DataFrame:
    """``facts`` left-joined to ``lookup`` on ``key``; ``lookup`` has one row per key.

    Meant for facts of which one key may hold a large share. Where both sides have one row per key
    a plain join does, and keeps their partitioning.

    No side is hinted: Spark broadcasts the lookup only when its measured size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges otherwise. Two things keep the
    second form even when one key holds a large share of ``facts``:

    * rows without a key can never match, so they are spread over as many buckets as there are
      shuffle partitions by the column ``spread_by``, the id of a fact, rather than all hashed to
      one task; no other column is read for that;
    * the bucket is part of the join key on both sides, so both inputs come straight from a
      shuffle Spark placed itself. That is the plan shape in which adaptive execution may split
      an oversized partition of ``facts``; a lookup that arrives already partitioned by the key
      (straight from its aggregation or window) would rule it out.
    """
    buckets = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64(spread_by), F.lit(buckets)).cast("int")
    left = facts.withColumn("_bucket", F.when(F.col(key).isNull(), spread).otherwise(F.lit(0)))
    # Always 0, but written so that the optimizer cannot fold it away.
    right = lookup.where(F.col(key).isNotNull()).withColumn("_bucket", F.pmod(F.hash(key), F.lit(1)))
    return left.join(right, [key, "_bucket"], "left").drop("_bucket")
