"""Runs of single days into one set of tables against one run over all."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.operators import cells, rollups
from frostline.operators.decisions import decide
from frostline.operators.storage import materialise
from frostline.plans import fixture
from frostline.settings import DecisionConfig
from frostline.sources import daily, results


@pytest.fixture(scope="module")
def decided(spark, sf_dir):
    config = DecisionConfig(thresholds=fixture.FIXTURE_THRESHOLDS)
    return materialise(decide(fixture.scored_telemetry(spark, sf_dir), config))


def rows(df):
    def plain(value):
        return round(value, 9) if isinstance(value, float) else value

    return sorted(str({k: plain(v) for k, v in r.asDict().items()}) for r in df.collect())


def days(decided):
    return [r[0] for r in decided.select(F.to_date(S.RECEIVED)).distinct().collect()]


def files(path):
    return {
        os.path.join(where, name): os.stat(os.path.join(where, name)).st_mtime_ns
        for where, _, names in os.walk(path)
        for name in names
        if name.startswith("part-")
    }


def on(decided, day):
    return decided.where(F.to_date(S.RECEIVED) == F.lit(day))


def test_two_days_in_two_runs_equal_one_run(spark, decided, tmp_path):
    first, second = sorted(days(decided))[:2]
    both = on(decided, first).unionByName(on(decided, second))
    daily.save_days(both, str(tmp_path / "one"))
    daily.save_days(on(decided, first), str(tmp_path / "two"))
    daily.save_days(on(decided, second), str(tmp_path / "two"))
    for read in (results.read_predictions, daily.dashboard, daily.overview):
        one, two = read(spark, str(tmp_path / "one")), read(spark, str(tmp_path / "two"))
        assert one.dtypes == two.dtypes and rows(one) == rows(two)
    assert rows(daily.dashboard(spark, str(tmp_path / "two"))) == rows(rollups.risk_dashboard(both))


def test_a_repeated_day_replaces_only_itself(spark, decided, tmp_path):
    base = str(tmp_path)
    first, second = sorted(days(decided))[:2]
    daily.save_days(on(decided, first), base)
    before = files(tmp_path)
    daily.save_days(on(decided, second), base)
    changed = on(decided, second).withColumn("pred_attack_bin", F.lit(1))
    daily.save_days(changed, base)
    assert {f: t for f, t in files(tmp_path).items() if f in before} == before
    expected = rollups.risk_dashboard(on(decided, first).unionByName(changed))
    assert rows(daily.dashboard(spark, base)) == rows(expected)
    results.write_predictions(on(decided, first), base, replace_all=True)
    assert results.read_predictions(spark, base).select("date").distinct().count() == 1


def test_late_rows_rewrite_only_their_days(spark, decided, tmp_path):
    base = str(tmp_path)
    some = sorted(days(decided))[:4]
    here = decided.where(F.to_date(S.RECEIVED).isin(some))
    late = (F.to_date(S.RECEIVED) == F.lit(some[1])) & (F.col(S.ROW_ID) % 3 == 0)
    daily.save_days(here.where(~late), base)
    before = files(tmp_path)
    daily.add_late(here.where(late), base)
    after = files(tmp_path)
    gone = {f for f in before if f not in after}
    assert gone and all(f"date={some[1]}" in f for f in gone)
    assert all(f"date={some[1]}" in f for f in after if f not in before)
    assert rows(daily.dashboard(spark, base)) == rows(rollups.risk_dashboard(here))
    # again, with a row corrected: replaced, not added
    fixed = here.where(late).withColumn("operational_label", F.lit(S.GEOFENCE))
    daily.add_late(fixed.unionByName(fixed), base)
    expected = here.where(~late).unionByName(fixed)
    assert results.read_predictions(spark, base).count() == here.count()
    assert rows(daily.dashboard(spark, base)) == rows(rollups.risk_dashboard(expected))


def test_late_rows_before_any_run_and_without_time(spark, decided, tmp_path):
    base = str(tmp_path)
    timeless = decided.limit(3).withColumn(S.RECEIVED, F.lit(None).cast("timestamp_ntz"))
    daily.add_late(on(decided, sorted(days(decided))[0]).unionByName(timeless), base)
    daily.add_late(timeless, base)
    found = results.read_predictions(spark, base)
    assert found.where("date is null").count() == 3
    assert rows(daily.dashboard(spark, base)) == rows(rollups.risk_dashboard(on(decided, sorted(days(decided))[0])))


def test_no_rows_change_nothing(spark, decided, tmp_path):
    base = str(tmp_path)
    daily.save_days(on(decided, sorted(days(decided))[0]), base)
    before = files(tmp_path)
    daily.save_days(decided.limit(0), base)
    daily.add_late(decided.limit(0), base)
    assert files(tmp_path) == before


def test_other_days_are_not_opened(spark, decided, tmp_path):
    daily.save_days(decided, str(tmp_path))
    part = daily.dashboard(spark, str(tmp_path), ("2024-01-05", "2024-01-06"))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and 0 < part.select("date").distinct().count() <= 2


def test_cells_merge(decided):
    whole = cells.day_cells(decided)
    parts = [cells.day_cells(decided.where(F.col(S.ROW_ID) % 3 == k)) for k in range(3)]
    merged = cells.merge_cells(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert rows(merged.select(*whole.columns)) == rows(whole)
    assert rows(cells.dashboard_of(merged)) == rows(rollups.risk_dashboard(decided))
    assert rows(cells.anomaly_days_of(merged)) == rows(rollups.anomaly_days(decided))
    assert rows(cells.device_counts_of(merged)) == rows(rollups.device_counts(decided))
    assert rows(cells.top_labels_of(merged)) == rows(rollups.top_labels(decided))


def test_devices_of_any_range_by_sketches(spark):
    """Devices that report on many days count once."""
    reports = spark.range(200_000).select(
        F.concat(F.lit("D"), (F.col("id") * 7919 % 60_000).cast("string")).alias(S.DEVICE),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("date"),
        F.lit(1).cast("long").alias("n"),
        F.lit(0).cast("long").alias("attacks"),
        F.lit(0).cast("long").alias("alerts"),
    )
    totals = materialise(cells.day_totals(reports))
    assert totals.count() == 20
    for first, last in (("2024-01-01", "2024-01-20"), ("2024-01-03", "2024-01-09"), ("2025-01-01", "2025-01-02")):
        within = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        exact = reports.where(within).select(S.DEVICE).distinct().count()
        found = cells.overview_of(totals.where(within)).first()
        assert abs(found["devices"] - exact) <= 0.03 * exact
        assert found["rows"] == reports.where(within).count()
    # the union reads one row per day
    plan = cells.overview_of(totals)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def test_null_devices_and_labels(spark):
    schema = (
        "Device_ID string, timestamp timestamp_ntz, event_id long, operational_label string, recommended_action string,"
        " pred_attack_bin int, primary_label_reported string, op_best_score double, risk_score_combined double,"
        " cvss double, epss double, dvd double"
    )
    at = datetime(2024, 1, 1, 5)
    df = spark.createDataFrame(
        [(None, at, 1, None, None, None, None, None, None, None, None, None), ("A", at, 2, "normal", None, 1, "normal", 0.5, None, 1.0, None, 2.0)], schema
    )
    assert rows(cells.dashboard_of(cells.day_cells(df))) == rows(rollups.risk_dashboard(df))
    found = cells.overview_of(cells.day_totals(cells.day_cells(df))).first()
    assert (found["devices"], found["rows"], found["cyber_alerts"]) == (1, 2, 1)
