import datetime as dt

import pytest
from pyspark.sql import functions as F

from lossledger.operators.attribution import attribute_deals, best_note_per_deal
from lossledger.operators.lookups import lookup_join
from tests.conftest import final_plan, planned, rows

DAY = dt.date(2025, 1, 1)
NOTES = "note_id string, deal_id string, note_date date, category string, subcategory string, confidence double"


def deals(spark, data):
    return spark.createDataFrame(
        data, "deal_id string, competitor_mentioned string, discount_pct int, deal_value double"
    )


def test_fallback_without_note(spark):
    table = deals(spark, [
        ("d1", "None", 0, 100.0),
        ("d2", None, 0, 100.0),
        ("d3", "Canva", 0, 100.0),
        ("d4", "Canva", 20, 100.0),
        ("d5", None, 25, 100.0),
        ("d6", "Canva", None, 100.0),
        ("d7", "None", 15, 100.0),
    ])
    none = spark.createDataFrame([], NOTES)
    got = {r[0]: r[1:] for r in rows(attribute_deals(table, none).select(
        "deal_id", "deal_loss_category", "deal_loss_subcategory", "deal_loss_confidence", "effective_deal_value"))}
    assert got["d1"] == ("Uncategorized", "unclear_signal", 0.3, 100.0)
    assert got["d2"] == ("Uncategorized", "unclear_signal", 0.3, 100.0)
    assert got["d3"] == ("Competitive", "competitor_switch", 0.3, 100.0)
    assert got["d4"] == ("Commercial", "pricing_concerns", 0.3, 80.0)
    assert got["d5"] == ("Commercial", "pricing_concerns", 0.3, 75.0)
    assert got["d6"] == ("Competitive", "competitor_switch", 0.3, None)
    assert got["d7"] == ("Uncategorized", "unclear_signal", 0.3, 85.0)


def test_unclear_note_still_blocks_the_fallback(spark):
    table = deals(spark, [("d1", "Canva", 25, 100.0)])
    notes = spark.createDataFrame([("n1", "d1", DAY, "Uncategorized", "unclear_signal", 0.25)], NOTES)
    got = rows(attribute_deals(table, notes).select("deal_loss_category", "deal_loss_confidence"))
    assert got == [("Uncategorized", 0.25)]


def test_ties_go_to_the_earlier_note_then_the_smaller_id(spark):
    notes = spark.createDataFrame([
        ("n3", "d1", dt.date(2025, 1, 2), "A", "late", 0.7),
        ("n2", "d1", DAY, "A", "second", 0.7),
        ("n1", "d1", DAY, "A", "first", 0.7),
        ("n0", "d1", dt.date(2024, 1, 1), "A", "weak", 0.6),
        ("n9", "d2", None, "A", "undated", 0.7),
        ("n8", "d2", DAY, "A", "dated", 0.7),
    ], NOTES)
    got = dict(rows(best_note_per_deal(notes).select("deal_id", "deal_loss_subcategory")))
    assert got == {"d1": "first", "d2": "dated"}


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_outcome_does_not_depend_on_partitions(spark, partitions):
    notes = spark.range(2000).select(
        F.concat(F.lit("n"), F.col("id") % 37).alias("note_id"),
        F.concat(F.lit("d"), F.col("id") % 11).alias("deal_id"),
        F.lit(DAY).alias("note_date"),
        F.concat(F.lit("c"), F.col("id") % 5).alias("category"),
        F.concat(F.lit("s"), F.col("id") % 7).alias("subcategory"),
        ((F.col("id") % 3) / 10.0).alias("confidence"),
    )
    assert sorted(rows(best_note_per_deal(notes.repartition(partitions)))) == sorted(rows(best_note_per_deal(notes)))


def test_rank_prunes_before_the_shuffle(spark):
    notes = spark.createDataFrame([("n1", "d1", DAY, "A", "a", 0.7)], NOTES)
    plan = planned(best_note_per_deal(notes))
    before_shuffle = plan.split("Exchange")[-1]
    assert "WindowGroupLimit" in before_shuffle


def test_lookup_keeps_rows_without_key_or_match(spark):
    facts = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("z", 4)], "k string, v int")
    lookup = spark.createDataFrame([("a", "x"), (None, "never")], "k string, name string")
    got = sorted(rows(lookup_join(facts, lookup, "k", "v").select("v", "k", "name")))
    assert got == [(1, "a", "x"), (2, None, None), (3, None, None), (4, "z", None)]


def hot_join(spark, hot):
    facts = spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"),
        F.col("id").alias("v"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    names = spark.range(5001).select(
        F.when(F.col("id") == 5000, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"),
        F.col("id").alias("name"),
    )
    # One row per key, straight from an aggregation, as the operators produce it.
    return lookup_join(facts, names.groupBy("k").agg(F.max("name").alias("name")), "k", "v")


def no_broadcast(settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="64KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
    )


def test_hot_key_is_split_by_adaptive_execution(spark, settings):
    no_broadcast(settings)
    joined = hot_join(spark, "hot")
    plan = final_plan(joined)
    assert "SortMergeJoin(skew=true)" in plan
    assert joined.count() == 60000
    assert joined.where("k = 'hot' and name = 5000").count() == 20000


def test_rows_without_key_spread_over_partitions(spark, settings):
    no_broadcast(settings)
    settings(spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="8")
    joined = hot_join(spark, None)
    sizes = [r[0] for r in joined.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 60000 / 3
