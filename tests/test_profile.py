import random

import numpy as np
import pandas as pd
import pytest

from lossledger.operators import profile
from lossledger.operators.cumulative import running_totals
from lossledger.session import stage
from tests.conftest import rows


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


@pytest.mark.parametrize("size,distinct", [(1, 1), (2, 2), (7, 3), (1000, 12), (3000, 3000)])
def test_describe_matches_pandas(spark, size, distinct):
    rng = random.Random(size)
    values = [float(rng.randrange(distinct)) * 1.25 for _ in range(size)]
    got = dict(rows(profile.describe(column(spark, [*values, None]), "x")))
    want = pd.Series(values).describe().to_dict()
    for name, value in want.items():
        assert (got[name] is None and np.isnan(value)) or got[name] == pytest.approx(value), name


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 9.5], [3.0], [5.0, 5.0], np.linspace(-3, 8, 777).tolist()])
def test_histogram_matches_numpy(spark, values):
    counts, edges = np.histogram(values, bins=20)
    got = rows(profile.histogram(column(spark, [*values, None]), "x", 20))
    assert [r[3] for r in got] == counts.tolist()
    assert [r[1] for r in got] == pytest.approx(edges[:-1].tolist())
    assert [r[2] for r in got] == pytest.approx(edges[1:].tolist())


def test_histogram_of_nothing(spark):
    assert sum(r[3] for r in rows(profile.histogram(column(spark, []), "x", 4))) == 0


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [2, 5, 256])
def test_running_totals(spark, descending, buckets):
    keys = random.Random(1).sample(range(10000), 700)
    df = stage(spark.createDataFrame([(k, k % 13) for k in keys], "k int, n int"))
    got = {r[0]: r[2] for r in rows(running_totals(df, "k", {"upto": "n"}, descending=descending, buckets=buckets))}
    total, want = 0, {}
    for k in sorted(keys, reverse=descending):
        total += k % 13
        want[k] = total
    assert got == want


def test_running_totals_use_no_global_window_over_rows(spark):
    df = stage(spark.range(1000).selectExpr("id AS k", "1 AS n"))
    plan = running_totals(df, "k", {"upto": "n"})._jdf.queryExecution().executedPlan().toString()
    single = [part.split("\n")[1] for part in plan.split("Exchange SinglePartition")[1:]]
    # Only sums of partitions and the range totals go to one partition.
    assert single and all("functions=[partial_" in line or "HashAggregate(keys=[_range" in line for line in single)
    assert "TakeOrdered" not in plan


@pytest.mark.parametrize("buckets", [1, 7, 300])
def test_running_totals_do_not_depend_on_the_ranges(spark, buckets):
    df = stage(spark.range(500).selectExpr("id * 7 % 500 AS k", "1 AS n"))
    got = running_totals(df, "k", {"upto": "n"}, buckets=buckets)
    assert sorted(rows(got.select("k", "upto"))) == [(k, k + 1) for k in range(500)]


def test_null_and_value_counts(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", None), ("None", 4)], "s string, n int")
    assert rows(profile.null_counts(df, "t")) == [("t", "s", 1), ("t", "n", 1)]
    assert rows(profile.value_counts(df, "s")) == [("a", 2), ("None", 1)]
    assert sorted(rows(profile.value_counts(df, "s", dropna=False)), key=repr) == [("None", 1), ("a", 2), (None, 1)]


def test_win_rate_leaves_unknown_competitors_out(spark):
    df = spark.createDataFrame(
        [("Canva", "won"), ("Canva", "lost"), ("None", "won"), (None, "won")],
        "competitor_mentioned string, deal_status string",
    )
    assert rows(profile.win_rate_by_competitor(df)) == [("Canva", 0.5), ("None", 1.0)]


def test_churn_overview(spark):
    df = spark.createDataFrame([("pricing", 2.5), ("pricing", 1.0), ("low_usage", 4.0)], "reason_type string, churned_revenue double")
    assert sorted(rows(profile.churn_overview(df))) == [("all", 3, 7.5), ("low_usage", 1, 4.0), ("pricing", 2, 3.5)]
