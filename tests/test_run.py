import datetime as dt
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lossledger.operators.ledger import loss_events, lost_deals
from lossledger.operators.rollups import loss_trend, reconcile
from lossledger.plans import exports, views
from lossledger.plans.run import run
from lossledger.sources import sinks
from lossledger.sources.schemas import SCHEMAS
from lossledger.sources.tables import load_tables, read_table
from tests.conftest import rows


TEXTS = ["The budget is gone, so is the discount.", "figma again", "one more template, and a library of them",
         "crash after crash, slow as ever", "onboarding took a month", "no keyword in here", "low usage since May"]


def write_inputs(folder):
    """Six small CSV files with quoted commas, empty fields and the literal None."""
    rng = random.Random(11)
    day = lambda: dt.date(2025, 1, 1) + dt.timedelta(days=rng.randrange(400))
    ids = [f"A{i:05d}" for i in range(120)]
    plans = {"free": 0, "pro": 24, "team": 180}
    accounts, usage = [], []
    for a in ids:
        plan = rng.choice(list(plans))
        accounts.append([a, rng.choice(["solo", "mid_market"]), rng.choice(["media", "education"]),
                         rng.choice(["Asia", "Europe", ""]), plan, day(), plans[plan]])
        usage += [[a, dt.date(2025, 12, 1) + dt.timedelta(weeks=w), *(rng.randrange(9) for _ in range(6))] for w in range(6)]
    deals = [[f"D{i:05d}", rng.choice(ids), "ads", day(), 120 * rng.randrange(1, 9), rng.choice([0, 15, 20]),
              rng.choice(["None", "Canva", "Adobe Express"]), "demo", day(), rng.choice(["won", "lost"])] for i in range(300)]
    tickets = [[f"T{i}", rng.choice(ids), day(), rng.choice(["bug", "billing"]), rng.choice(["low", "high"]),
                rng.randrange(1, 90), rng.choice([1, 5, ""]), rng.choice(TEXTS), 24] for i in range(150)]
    notes = [[f"N{i}", f"D{rng.randrange(250):05d}", rng.choice(ids), day(),
              rng.choice([*TEXTS, 'He said "too slow", twice', ""])] for i in range(400)]
    cancelled = [[f"C{i}", rng.choice(ids[:40]), day(), 3, rng.choice(["True", "False"]),
                  rng.choice(TEXTS), 24, "pricing"] for i in range(60)]
    tables = {"accounts": accounts, "deals": deals, "product_usage": usage, "support_tickets": tickets,
              "sales_notes": notes, "cancellations": cancelled}

    notes += [["N900", "D00001", ids[0], day(), "  pricing at both ends  "], ["N901", "D00002", ids[1], day(), "two\nlines, \"slow\""]]

    def cell(value):
        text = str(value)
        return '"' + text.replace('"', '""') + '"' if set(text) & set(',"\n ') else text

    for name, data in tables.items():
        header = [part.split()[0] for part in SCHEMAS[name].split(",")]
        lines = [",".join(header), *(",".join(map(cell, row)) for row in data)]
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return tables


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    source, target = tmp_path_factory.mktemp("in"), tmp_path_factory.mktemp("out")
    data = write_inputs(source)
    assert not sinks.outputs_ready(spark, str(target))
    return data, str(source), str(target), run(spark, str(source), str(target), trees=10, multiline=True)


def test_csv_types_and_values(spark, finished):
    data, source, _, _ = finished
    tables = load_tables(spark, source)
    assert tables.accounts.count() == 120 and tables.usage.count() == 720
    assert tables.deals.where("competitor_mentioned = 'None'").count() == sum(d[6] == "None" for d in data["deals"])
    assert tables.accounts.where("region is null").count() == sum(a[3] == "" for a in data["accounts"])
    assert tables.cancellations.where("refund_requested").count() == sum(c[4] == "True" for c in data["cancellations"])
    assert tables.notes.where(F.col("note_text") == 'He said "too slow", twice').count() > 0
    assert dict(tables.deals.dtypes)["close_date"] == "date"


def test_bad_value_is_an_error(spark, tmp_path):
    (tmp_path / "sales_notes.csv").write_text("note_id,deal_id,account_id,note_date,note_text\nN1,D1,A1,not a day,x\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_table(spark, str(tmp_path), "sales_notes").collect()


def test_wrong_header_is_an_error(spark, tmp_path):
    (tmp_path / "sales_notes.csv").write_text("note_id,account_id,deal_id,note_date,note_text\nN1,A1,D1,2025-01-01,x\n")
    with pytest.raises(Exception, match="header"):
        read_table(spark, str(tmp_path), "sales_notes").collect()


def test_outputs_and_summary(spark, finished):
    data, _, target, result = finished
    assert sinks.outputs_ready(spark, target)
    outputs = sinks.load_outputs(spark, target)
    assert result["risk_rows"] == outputs["account_risk_scores"].count() == 120
    summed = outputs["revenue_loss_summary"].agg(F.sum("lost_revenue")).first()[0]
    assert result["revenue_loss_total"] == pytest.approx(summed)
    expected = sum(c[6] for c in data["cancellations"]) + sum(d[4] * (1 - d[5] / 100) for d in data["deals"] if d[9] == "lost")
    assert summed == pytest.approx(expected)
    assert set(result["metrics"]) == set(outputs["model_metrics"].columns)
    assert all(round(v, 4) == v for v in result["metrics"].values())
    features = spark.read.parquet(sinks.table_path(target, "account_features"))
    assert len(features.columns) == 30 and features.count() == 120
    assert spark.read.parquet(sinks.table_path(target, "deals_enriched")).count() == 300


def test_rollups_of_a_run_agree(spark, finished):
    outputs = sinks.load_outputs(spark, finished[2])
    compared = reconcile(outputs["revenue_loss_summary"], outputs["revenue_loss_trend"], outputs["segment_loss"])
    assert [r["agrees"] for r in compared.collect()] == [True, True]


def test_missing_output_is_an_error(spark, finished, tmp_path):
    assert not sinks.outputs_ready(spark, finished[2], ["no_such_table"])
    with pytest.raises(AnalysisException):
        sinks.load_outputs(spark, str(tmp_path))


def test_extracts_and_manifest(spark, finished, tmp_path):
    target = str(tmp_path / "extracts")
    manifest = {r["file_name"]: r for r in exports.export_views(spark, finished[2], target).collect()}
    assert len(manifest) == 10
    assert (manifest["risk_scores"]["row_count"], manifest["risk_scores"]["column_count"]) == (120, 9)
    assert manifest["evidence_cancellations"]["column_count"] == 12
    assert manifest["evidence_support_tickets"]["column_count"] == 13
    assert manifest["evidence_sales_notes"]["column_count"] == 9
    assert manifest["model_metrics"]["row_count"] == 7 and manifest["kpi_snapshot"]["row_count"] == 1
    for name, row in manifest.items():
        written = spark.read.csv(f"{target}/{name}", header=True, escape='"', multiLine=True)
        assert (written.count(), len(written.columns)) == (row["row_count"], row["column_count"]), name
    listed = spark.read.json(f"{target}/manifest")
    assert listed.count() == 10 and "generated_at_utc" in listed.columns
    counted = exports.count_manifest(exports.build_extracts(sinks.load_outputs(spark, finished[2])))
    assert {r[0]: r[1:] for r in rows(counted)} == {n: (r["row_count"], r["column_count"]) for n, r in manifest.items()}


def test_csv_outputs(spark, tmp_path):
    df = spark.createDataFrame([('say "x", y', 1), (None, 2)], "t string, n int")
    assert sinks.write_table(df, str(tmp_path / "t"), "csv") == 2
    back = sinks.read_output(spark, str(tmp_path / "t"), "csv")
    assert sorted(rows(back), key=repr) == sorted(rows(df), key=repr)


def test_filters_on_stored_tables_reach_the_scan(spark, finished):
    outputs = sinks.load_outputs(spark, finished[2])
    deals = spark.read.parquet(sinks.table_path(finished[2], "deals_enriched"))

    def scan(df):
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        return df._jdf.queryExecution().explainString(mode)

    assert "EqualTo(deal_status,lost)" in scan(lost_deals(deals).select("deal_id"))
    chosen = views.at_risk(views.choose(outputs["account_risk_scores"], ["pro"], ["Asia", "Europe"]), 0.3)
    plan = scan(chosen.select("account_id"))
    assert "EqualTo(plan_type,pro)" in plan or "In(plan_type" in plan
    assert "In(region, [Asia,Europe])" in plan and "GreaterThanOrEqual(churn_probability,0.3)" in plan
    assert "monthly_revenue" not in plan


def test_rollups_of_stored_tables_read_few_columns(spark, finished):
    stored = {n: spark.read.parquet(sinks.table_path(finished[2], n)) for n in ("deals_enriched", "cancellations_classified")}
    events = loss_events(stored["deals_enriched"], stored["cancellations_classified"])
    plan = loss_trend(events)._jdf.queryExecution().executedPlan().toString()
    assert "note_text" not in plan and "cancellation_reason_text" not in plan and "Join" not in plan
    # One shuffle for the months, one for their order.
    assert plan.count("Exchange") == 2


def test_csv_outputs_equal_parquet_outputs(spark, finished, tmp_path):
    _, source, target, _ = finished
    run(spark, source, str(tmp_path / "out"), trees=10, multiline=True, out_fmt="csv")
    names = (*sinks.REQUIRED, "deals_enriched", "account_features")
    plain, text = sinks.load_outputs(spark, target, names), sinks.load_outputs(spark, str(tmp_path / "out"), names, fmt="csv")
    for name in names:
        assert text[name].schema == plain[name].schema, name
        if name != "account_risk_scores":  # scores depend on the order in which the forest sees rows
            assert sorted(rows(text[name]), key=str) == sorted(rows(plain[name]), key=str), name
    odd = {r["note_id"]: r["note_text"] for r in text["sales_notes_classified"].where("note_id >= 'N900'").collect()}
    assert odd["N900"] == "  pricing at both ends  " and odd["N901"] == 'two\nlines, "slow"'
    manifest = exports.export_views(spark, str(tmp_path / "out"), str(tmp_path / "views"), source_fmt="csv")
    assert {r["file_name"]: r["row_count"] for r in manifest.collect()}["evidence_sales_notes"] == 402
