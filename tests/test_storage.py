"""Bad lines, partitions that are refreshed alone, and filters that reach the scan."""

import datetime as dt
import re
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as registered
from lossledger.operators.attribution import attribute_deals, notes_of
from lossledger.operators.taxonomy import classify
from lossledger.plans.run import run
from lossledger.sources import sinks
from lossledger.sources.tables import load_checked, load_tables, read_checked
from tests.conftest import planned, rows
from tests.test_run import write_inputs

DATA = "/root/testdata/sf0.001"
driver_tables = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")


def test_bad_lines_are_set_aside_whole(spark, tmp_path):
    good = ["A1,solo,media,Asia,free,2025-01-02,0", 'A2,solo,"media, print",,pro,,24.5']
    bad = ["A3,solo,media,Asia,free,soon,0", "A4,solo,media,Asia,free,2025-01-02,much", "A5,solo", "A6,a,b,c,d,2025-01-02,1,too,many"]
    header = "account_id,company_size,industry,region,plan_type,signup_date,monthly_revenue"
    (tmp_path / "accounts.csv").write_text("\n".join([header, *good[:1], *bad, *good[1:]]) + "\n")
    fine, aside = read_checked(spark, str(tmp_path), "accounts")
    assert sorted(rows(fine)) == [("A1", "solo", "media", "Asia", "free", dt.date(2025, 1, 2), 0.0),
                                  ("A2", "solo", "media, print", None, "pro", None, 24.5)]
    assert sorted(rows(aside)) == [("accounts", line) for line in bad]
    (tmp_path / "accounts.csv").write_text(header + "\n")
    fine, aside = read_checked(spark, str(tmp_path), "accounts")
    assert rows(fine) == rows(aside) == []


def test_run_with_quarantine(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    write_inputs(source)
    clean, none = load_checked(spark, str(source), multiline=True)
    assert rows(none) == []
    plain = load_tables(spark, str(source), multiline=True)
    for name in ("accounts", "deals", "usage", "support", "notes", "cancellations"):
        assert sorted(rows(getattr(clean, name)), key=repr) == sorted(rows(getattr(plain, name)), key=repr)
    for name, line in (("deals", "D9,A00001,ads,never,120,0,None,demo,2025-01-01,won"), ("accounts", "A9")):
        with open(source / f"{name}.csv", "a") as file:
            file.write(line + "\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|cannot be parsed"):
        rows(load_tables(spark, str(source), multiline=True).deals)
    result = run(spark, str(source), target, multiline=True, trees=5, quarantine=True)
    assert result["quarantined_rows"] == 2 and result["risk_rows"] == 120
    aside = spark.read.parquet(sinks.table_path(target, "quarantine"))
    assert sorted(rows(aside)) == [("accounts", "A9"), ("deals", "D9,A00001,ads,never,120,0,None,demo,2025-01-01,won")]
    with pytest.raises(ValueError):
        run(spark, str(source), target, in_fmt="parquet", quarantine=True)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_refreshing_a_month_leaves_the_others_untouched(spark, tmp_path, fmt):
    path = str(tmp_path / "trend")
    trend = spark.createDataFrame([(m, i * 1.5, None) for i, m in enumerate(["2024-01", "2024-02", "2024-10", None])],
                                  "period string, loss double, note string").select("loss", "period", "note")
    assert sinks.write_table(trend, path, fmt, partition="period") == 4
    state = lambda: {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in (tmp_path / "trend").rglob(f"part*.{fmt}")}
    before = state()
    assert len(before) == 4 and (tmp_path / "trend" / "period=2024-10").is_dir()
    again = trend.where("period = '2024-02'").withColumn("loss", F.lit(99.0))
    assert sinks.refresh_partitions(again, path, "period", fmt) == 1
    kept = {p: s for p, s in before.items() if "2024-02" not in str(p)}
    assert len(kept) == 3 and kept.items() <= state().items() and not before.items() <= state().items()
    read = sinks.read_output(spark, path, fmt, partitioned=True)
    assert read.schema == trend.schema
    assert sorted(rows(read), key=repr) == sorted([(0.0, "2024-01", None), (99.0, "2024-02", None), (3.0, "2024-10", None),
                                                   (4.5, None, None)], key=repr)
    assert re.search(r"PartitionFilters: \[[^\]]*period", planned(read.where("period = '2024-10'")))
    assert sinks.write_table(again, path, fmt, partition="period") == 1  # a whole write leaves nothing old
    assert rows(sinks.read_output(spark, path, fmt, partitioned=True)) == [(99.0, "2024-02", None)]
    with pytest.raises(AnalysisException):
        sinks.read_output(spark, str(tmp_path / "missing"), fmt, partitioned=True)


def test_notes_of_other_deals_are_not_looked_at(spark):
    deals = spark.createDataFrame([(1, 100.0, 0, "None"), (2, 50.0, 30, "None")], "deal_id int, deal_value double, discount_pct int, competitor_mentioned string")
    notes = spark.createDataFrame([(1, 1, dt.date(2025, 1, 1), "slow"), (2, 9, dt.date(2025, 1, 1), "pricing"), (3, None, None, "export")],
                                  "note_id int, deal_id int, note_date date, note_text string")
    some = notes_of(notes, deals)
    assert rows(some.select("note_id")) == [(1,)]
    assert sorted(rows(attribute_deals(deals, classify(some, "note_text")))) == sorted(rows(attribute_deals(deals, classify(notes, "note_text"))))


@driver_tables
def test_only_notes_of_lost_deals_are_classified(spark):
    plan = planned(registered.queries()["a08_lost_deals_by_cause"](spark, DATA))
    assert plan.index("_n0#") < plan.index("LeftSemi")  # the counting stands above the semi-join
    assert "EqualTo(o_orderstatus,F)" in plan
    events = planned(registered.queries()["a11_lost_deals_by_month"](spark, DATA))
    assert "EqualTo(o_orderstatus,F)" in events


@driver_tables
def test_reconciliation_reads_a_stored_ledger(spark):
    plan = planned(registered.queries()["v08_reconciliation"](spark, DATA))
    assert "Contains" not in plan and "lineitem" not in plan
