from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.operators import rollups
from frostline.operators.lookups import attach_per_device, replace_posture
from frostline.operators.series import SplitPolicy
from frostline.operators.split import mark_validation, train_and_validation
from frostline.plans import fixture

DECIDED = (
    "Device_ID string, timestamp timestamp_ntz, event_id long, operational_label string,"
    " recommended_action string, pred_attack_bin int, op_best_score double,"
    " risk_score_combined double, cvss double, epss double, dvd double,"
    " primary_label_reported string, score_attack_sup double"
)


def _decided(spark, rows):
    return spark.createDataFrame(
        [
            (dev, ts, i, label, action, attack, 0.1 * i, 0.5, 1.0, 0.2, 3.0, truth, 0.25 * i)
            for i, (dev, ts, label, action, attack, truth) in enumerate(rows)
        ],
        DECIDED,
    )


def _at(day, hour, minute=0):
    return datetime(2024, 1, day, hour, minute)


def test_tied_modes_take_the_value_seen_first(spark):
    df = _decided(
        spark,
        [
            ("A", _at(1, 3), "normal", S.MONITOR, 0, "normal"),
            ("A", _at(1, 1), S.GEOFENCE, S.PATCH, 1, S.CYBER),
            ("A", _at(1, 2), "normal", S.ISOLATE, 0, "normal"),
            ("A", _at(1, 4), S.GEOFENCE, S.PATCH, 0, "normal"),
            ("A", None, S.TAMPER, S.MONITOR, 1, "normal"),
        ],
    )
    row = rollups.risk_dashboard(df).collect()
    assert len(row) == 1  # a row without a time belongs to no day
    assert row[0]["op_label_top"] == S.GEOFENCE and row[0]["rec_action"] == S.PATCH
    assert row[0]["has_cyber"] == 1 and row[0]["date"] == date(2024, 1, 1)
    dated = df.selectExpr("*", "to_date(timestamp) AS date").where("date IS NOT NULL")
    top = rollups.most_frequent(dated, ["Device_ID", "date"], "operational_label").first()
    assert top["operational_label"] == S.GEOFENCE


def test_posture_bumps(spark):
    joined = spark.createDataFrame(
        [
            ("D001", 8.7, 0.17, 0.55, 3, 100, 1, 9),
            ("D002", 5.4, 0.01, 0.42, 3, 100, 0, 9),
            ("D003", 5.6, 0.99, 9.8, 20, 1000, 12, 9),
            ("D004", 6.9, 0.57, 0.58, 2, 0, 0, 9),
        ],
        "Device_ID string, cvss double, epss double, dvd double, cyber_days long,"
        " cyber_total long, op_days long, samples long",
    )
    rows = {r["Device_ID"]: r for r in rollups.posture_summary(rollups.bump_posture(joined)).collect()}
    assert rows["D001"]["cvss_final"] == 8.7  # severe already
    assert rows["D001"]["epss_final"] == pytest.approx(0.17 + 0.06 + 0.05)
    assert rows["D001"]["dvd_final"] == pytest.approx(0.60)
    assert rows["D002"]["cvss_final"] == pytest.approx(5.9)
    assert rows["D003"]["epss_final"] == 1.0 and rows["D003"]["dvd_final"] == 10.0
    assert rows["D004"]["cvss_final"] == 6.9  # too few days
    deltas = rollups.posture_deltas(rollups.posture_summary(rollups.bump_posture(joined)))
    assert all(r[f"delta_{c}"] >= 0 for r in deltas.collect() for c in S.POSTURE_MEASURES)
    assert [r["Device_ID"] for r in rollups.largest_increases(deltas, "dvd", 2).collect()] == ["D003", "D001"]


def test_devices_without_reports_count_zero(spark):
    posture = spark.createDataFrame([("A", 1.0, 0.1, 0.0), ("Z", 2.0, 0.2, 0.0)], "Device_ID string, cvss double, epss double, dvd double")
    df = _decided(spark, [("A", _at(d, 1), S.TAMPER, S.MONITOR, 1, "normal") for d in (1, 2, 3)])
    rows = {r["Device_ID"]: r for r in rollups.update_posture(posture, df).collect()}
    assert (rows["A"]["cyber_days"], rows["A"]["op_days"], rows["A"]["samples"]) == (3, 3, 3)
    assert rows["A"]["cvss_final"] == 1.5
    assert rows["Z"]["samples"] == 0 and rows["Z"]["epss_final"] == 0.2


def test_gap_filled_bins(spark):
    df = _decided(
        spark,
        [
            ("A", _at(1, 0, 1), "normal", S.MONITOR, 0, "normal"),
            ("A", _at(1, 0, 4), "normal", S.MONITOR, 1, S.CYBER),
            ("A", _at(1, 0, 17), "normal", S.MONITOR, 0, "normal"),
            ("B", _at(1, 5), "normal", S.MONITOR, 0, "normal"),
        ],
    )
    rows = [tuple(r) for r in rollups.fill_bins(rollups.time_bins(df)).orderBy("Device_ID", "timestamp").collect()]
    assert rows == [
        ("A", _at(1, 0, 0), 0.125, 1, 1),
        ("A", _at(1, 0, 5), None, None, None),
        ("A", _at(1, 0, 10), None, None, None),
        ("A", _at(1, 0, 15), 0.5, 0, 0),
        ("B", _at(1, 5), 0.75, 0, 0),
    ]


def test_overview_of_an_empty_table(spark):
    row = rollups.overview(_decided(spark, [])).first()
    assert tuple(row) == (0, 0, 0.0, 0)


def test_false_alarms_are_counted_against_normal(spark):
    df = _decided(
        spark,
        [
            ("A", _at(1, 1), "normal", S.MONITOR, 1, "normal"),
            ("A", _at(1, 2), "normal", S.MONITOR, 1, S.GEOFENCE),
            ("A", _at(2, 1), "normal", S.MONITOR, 0, "normal"),
            ("B", _at(1, 1), "normal", S.MONITOR, 1, "normal"),
        ],
    )
    assert rollups.false_alarm_rate(df, "pred_attack_bin").first()[0] == pytest.approx(2 / 3)
    per = {r[0]: r[1] for r in rollups.false_alarms_per_device(df, "pred_attack_bin").collect()}
    assert per == {"A": 0.5, "B": 1.0}


def test_findings_with_missing_probability(spark):
    df = spark.createDataFrame(
        [("A", "v1", 5.0, 0.5), ("A", "v2", 7.0, 0.5), ("A", "v2", 9.0, None)],
        "Device_ID string, vuln_id string, cvss double, epss double",
    )
    assert tuple(rollups.posture_from_findings(df).first()) == ("A", 7.0, 9.0, 0.75, 2)


def test_large_device_table_gives_the_same_join(spark, sf_dir):
    facts = fixture.telemetry(spark, sf_dir).drop(*S.POSTURE_MEASURES)
    devices = rollups.posture_from_telemetry(fixture.telemetry(spark, sf_dir)).where("Device_ID <> 'D002'")
    small = attach_per_device(facts, devices, S.DEVICE)
    heavy = attach_per_device(facts, devices, S.DEVICE, broadcast_rows=2, policy=SplitPolicy(max_rows=100))
    shuffled = attach_per_device(facts, devices, S.DEVICE, broadcast_rows=2)
    columns = small.columns
    expected = sorted(map(str, small.select(columns).collect()))
    assert sorted(map(str, heavy.select(columns).collect())) == expected
    assert sorted(map(str, shuffled.select(columns).collect())) == expected


def test_small_posture_is_broadcast_and_clashing_columns_go(spark, sf_dir):
    telemetry = fixture.telemetry(spark, sf_dir)
    joined = replace_posture(telemetry, rollups.posture_from_telemetry(telemetry))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert joined.columns.count("dvd") == 1 and "cvss" not in joined.columns


def test_split_keeps_one_training_row_per_device(spark, sf_dir):
    sizes = {"A": 1, "B": 2, "C": 10, "D": 7}
    rows = [(d, _at(1, h), h) for d, n in sizes.items() for h in range(n)]
    df = spark.createDataFrame(rows, "Device_ID string, timestamp timestamp_ntz, event_id long")
    train, held_out = train_and_validation(mark_validation(df))
    counts = {r[0]: r[1] for r in train.groupBy("Device_ID").count().collect()}
    assert counts == {"A": 1, "B": 1, "C": 8, "D": 5}
    assert held_out.count() == sum(sizes.values()) - sum(counts.values())


def test_split_of_single_row_devices_falls_back_to_a_sample(spark):
    rows = [(f"D{i}", _at(1, 1), i) for i in range(200)]
    df = spark.createDataFrame(rows, "Device_ID string, timestamp timestamp_ntz, event_id long")
    train, held_out = train_and_validation(mark_validation(df))
    assert train.count() == 200 and 15 < held_out.count() < 70


def test_rollups_aggregate_before_the_shuffle(spark, sf_dir):
    df = fixture.findings(spark, sf_dir)
    plan = rollups.posture_from_findings(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan and "partial_" in plan
    label = rollups.top_labels(_decided(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in label


def test_a_gap_of_decades_is_made_of_bounded_arrays(spark):
    """One clock at 1970: about 5.7 million bins, no array of more than a block."""
    rows = [("A", datetime(1970, 1, 1), 0.5, 1, 0), ("A", datetime(2024, 3, 1, 0, 5), 0.25, 0, 1), ("B", datetime(2024, 3, 1), 0.1, 0, 0)]
    rows += [("B", datetime(2024, 3, 1, 0, 20), 0.2, 0, 0)]
    bins = spark.createDataFrame(rows, "Device_ID string, timestamp timestamp_ntz, score_attack_sup double, pred_attack_bin int, is_cyber_true int")
    filled = rollups.fill_bins(bins)
    assert filled.dtypes == bins.dtypes
    bounds = filled.groupBy("Device_ID").agg(
        F.count(F.lit(1)), F.countDistinct("timestamp"), F.min("timestamp"), F.max("timestamp"), F.count("score_attack_sup")
    )
    first, last = datetime(1970, 1, 1), datetime(2024, 3, 1, 0, 5)
    size = int((last - first).total_seconds()) // 300 + 1
    found = {r[0]: tuple(r)[1:] for r in bounds.collect()}
    assert found == {"A": (size, size, first, last, 2), "B": (5, 5, datetime(2024, 3, 1), datetime(2024, 3, 1, 0, 20), 2)}
    assert "sequence(" in filled._jdf.queryExecution().optimizedPlan().toString()
    assert filled.where("timestamp = timestamp_ntz'1970-01-01 00:05:00' AND score_attack_sup IS NULL").count() == 1
