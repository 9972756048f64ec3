import json
from datetime import date, datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.operators.decisions import decide
from frostline.operators import rollups, split
from frostline.operators.features import engineer_features
from frostline.operators.rollups import risk_dashboard, update_posture
from frostline.plans import fixture
from frostline.settings import DecisionConfig, Persistence, Thresholds
from frostline.sources import results
from frostline.sources.telemetry import (
    feature_availability,
    first_existing,
    has_gps,
    loss_report,
    normalise,
    quarantined,
    read_telemetry,
    require_columns,
    write_telemetry,
)


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_missing_required_column_is_an_error(spark):
    df = spark.createDataFrame([("D1", "x")], "Device_ID string, timestamp string")
    with pytest.raises(ValueError, match=S.LABEL):
        normalise(df)


def test_csv_is_typed_leniently_and_defaulted(spark, tmp_path):
    path = _write(
        tmp_path / "t.csv",
        "Device_ID,timestamp,primary_label_reported,temp_reported,cvss\n"
        " D001 ,2024-01-02 03:04:05,normal,4.5,NaN\n"
        "7,not a time,normal,cold,5.5\n"
        ",2024-01-02,normal,,\n",
    )
    rows = read_telemetry(spark, path).orderBy(S.ROW_ID).collect()
    assert [r["Device_ID"] for r in rows] == ["D001", "7", "nan"]
    assert [r["timestamp"] for r in rows] == [datetime(2024, 1, 2, 3, 4, 5), None, datetime(2024, 1, 2)]
    assert [r["temp_reported"] for r in rows] == [4.5, None, None]
    # a NaN is a missing value, an absent column is zero
    assert [r["cvss"] for r in rows] == [None, 5.5, None]
    assert {r["epss"] for r in rows} == {0.0} and {r["lat_reported"] for r in rows} == {0.0}
    assert {r["timestamp_reported"] for r in rows} == {None}
    assert {(r["tamper_reported"], r["is_augmented"]) for r in rows} == {(0, 0)}


def test_day_first_dates_need_a_pattern(spark, tmp_path):
    path = _write(
        tmp_path / "t.csv",
        "Device_ID,timestamp,primary_label_reported\nA,03/01/2025 10:00,normal\nA,13/01/2025 10:00,normal\n",
    )
    rows = read_telemetry(spark, path, timestamp_pattern="dd/MM/yyyy HH:mm").orderBy(S.ROW_ID).collect()
    assert [r["timestamp"] for r in rows] == [datetime(2025, 1, 3, 10), datetime(2025, 1, 13, 10)]


def test_first_existing_path_is_read(spark, tmp_path):
    header = "Device_ID,timestamp,primary_label_reported\n"
    there = _write(tmp_path / "b.csv", header + "B,2024-01-01,normal\n")
    df = read_telemetry(spark, [str(tmp_path / "a.csv"), there])
    assert df.first()["Device_ID"] == "B"
    with pytest.raises(FileNotFoundError):
        first_existing([str(tmp_path / "none.csv")], spark.read.csv)


def test_feature_availability(spark):
    df = spark.createDataFrame([("A", "2024-01-01", "normal")], "Device_ID string, timestamp string, primary_label_reported string")
    assert not has_gps(df)
    assert feature_availability(df).first().asDict() == {"gps": False, "timestamp_reported": False, "tamper_reported": False}
    full = feature_availability(normalise(df)).first().asDict()
    assert full == {"gps": True, "timestamp_reported": False, "tamper_reported": True}


def test_posture_and_findings_csv(spark, tmp_path):
    path = _write(tmp_path / "p.csv", "Device_ID,cvss,epss,dvd,nist_gap_count\nD001,8.7,0.17,0.55,4\nD004,7,0.57,0.58,10\n")
    assert [tuple(r) for r in results.read_posture(spark, path).orderBy("Device_ID").collect()] == [
        ("D001", 8.7, 0.17, 0.55, 4),
        ("D004", 7.0, 0.57, 0.58, 10),
    ]
    path = _write(tmp_path / "f.csv", "Device_ID,vuln_id,cvss,epss\nD001,V-1,5.0,\n")
    assert tuple(results.read_findings(spark, path).first()) == ("D001", "V-1", 5.0, None)


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_results_survive_a_round_trip(spark, sf_dir, tmp_path, format):
    base = str(tmp_path / "out")
    config = DecisionConfig(thresholds=fixture.FIXTURE_THRESHOLDS)
    decided = decide(fixture.scored_telemetry(spark, sf_dir), config)
    posture = fixture.posture(spark, sf_dir)
    assert all(v is None for v in results.read_results(spark, base).values())

    results.write_predictions(decided, base, format=format)
    results.write_dashboard(risk_dashboard(decided), base)
    results.write_posture(posture, update_posture(posture, decided), base)
    results.write_metadata(results.metadata(spark, Persistence(), Thresholds(), "n"), base)

    back = results.read_predictions(spark, base, format=format)
    key = ["event_id", "operational_label", "op_best_score", "pred_attack_bin", "recommended_action"]
    assert {tuple(str(v) for v in r) for r in back.select(key).collect()} == {
        tuple(str(v) for v in r) for r in decided.select(key).collect()
    }
    if format == "parquet":
        saved = results.read_results(spark, base)
        assert saved["risk_dashboard"].count() == risk_dashboard(decided).count()
        assert saved["initial_posture"].count() == saved["final_posture_summary"].count() == 10
        meta = saved["metadata"].first()
        assert meta["persistence"] == {"temp": 4, "geo": 4, "tamper": 1, "attack": 2}
        assert meta["thresholds"]["attack_sup_base"] == 0.44645437053393533
        assert meta["features"]["attack_feats"] == list(S.ATTACK_FEATURES)
        assert json.loads(saved["metadata"].toJSON().first())["notes"] == "n"


def test_days_are_pruned_from_saved_predictions(spark, sf_dir, tmp_path):
    base = str(tmp_path / "out")
    decided = decide(fixture.scored_telemetry(spark, sf_dir))
    results.write_predictions(decided, base)
    day = results.read_predictions(spark, base).where("date = DATE '2024-01-05'")
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().executedPlan().toString()
    assert 0 < day.count() < decided.count()


def test_saved_predictions_must_be_complete(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "predictions"))
    with pytest.raises(ValueError, match="pred_attack_bin"):
        results.read_predictions(spark, str(tmp_path))
    with pytest.raises(ValueError):
        require_columns(spark.range(1), ["absent"])


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_flags_written_as_decimals(spark, tmp_path, zone):
    header = "Device_ID,timestamp,primary_label_reported,tamper_reported,is_augmented\n"
    rows = "A,2024-01-01,normal,1.0,0.0\nA,2024-01-02,normal,,1\nA,2024-01-03,normal,x,0\n"
    df = read_telemetry(spark, _write(tmp_path / "f.csv", header + rows))
    found = [(r["tamper_reported"], r["is_augmented"]) for r in df.orderBy("timestamp").collect()]
    assert found == [(1, 0), (None, 1), (None, 0)]
    assert split.without_augmented(df).count() == 2


def test_missing_positions_are_not_standing_still(spark, tmp_path, zone):
    header = "Device_ID,timestamp,primary_label_reported\n"
    lines = "".join(f"A,2024-01-01 00:0{k}:00,normal\n" for k in range(5))
    df = read_telemetry(spark, _write(tmp_path / "g.csv", header + lines))
    assert not has_gps(df) and {"lat_reported", "lon_reported"} <= set(df.columns)
    assert {r["gps_repeat_count"] for r in engineer_features(df).collect()} == {0}
    kept = df.withColumn("more", F.lit(1)).select("*")
    assert not has_gps(kept)


def test_hours_do_not_follow_the_session_zone(spark, zone):
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00' AS timestamp, 'normal' AS operational_label")
    assert rollups.hourly_labels(df).first()["hour"] == datetime(2024, 3, 10, 2)


def test_indented_metadata_reads_back(spark, tmp_path, zone):
    folder = tmp_path / "run" / results.METADATA
    folder.mkdir(parents=True)
    text = json.dumps({"persistence": {"temp": 4}, "thresholds": {"temp": 0.5}, "notes": "n"}, indent=2)
    (folder / "part.json").write_text(text)
    rows = results.read_metadata(spark, str(tmp_path / "run")).collect()
    assert len(rows) == 1 and rows[0]["persistence"] == {"temp": 4} and rows[0]["thresholds"] == {"temp": 0.5}


def test_csv_dashboard_reads_back(spark, tmp_path, zone):
    row = ("D1", date(2024, 3, 10), 1, "normal", 0.5, 0.25, 8.0, 0.5, 2.0, "MONITOR")
    df = spark.createDataFrame([row], results.DASHBOARD_SCHEMA)
    results.write_dashboard(df, str(tmp_path / "out"), format="csv")
    found = results.read_results(spark, str(tmp_path / "out"), format="csv")[results.DASHBOARD]
    assert found.dtypes == df.dtypes and [tuple(r) for r in found.collect()] == [row]


def _scan(df):
    """Rows that the one scan of df handed on, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.toString(), leaf.metrics().apply("numOutputRows").value()


def test_device_filters_reach_the_files(spark, sf_dir, tmp_path):
    path = str(tmp_path / "layout")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    telemetry = fixture.telemetry(spark, sf_dir)
    more = telemetry.withColumn("Device_ID", F.explode(F.array([F.concat("Device_ID", F.lit(f"-{k}")) for k in range(40)])))
    write_telemetry(more, path, partitions=4, row_group_bytes=32 << 10)
    total = more.count()
    everything = read_telemetry(spark, path, format="parquet")
    assert everything.count() == total
    for rows in (
        everything.where("Device_ID = 'D002-7'"),
        read_telemetry(spark, path, format="parquet", devices=["D002-7"]),
    ):
        text, read = _scan(rows)
        assert "EqualTo(Device_ID,D002-7)" in text or "In(Device_ID" in text
        assert rows.count() == telemetry.where("Device_ID = 'D002'").count() <= read < total / 4
    text, read = _scan(read_telemetry(spark, path, format="parquet", devices=["D002-7", "D004-1"], between=("2024-01-05", "2024-01-06")))
    assert "GreaterThanOrEqual(timestamp,2024-01-05T00:00)" in text and read < total / 4
    # no such device: the Bloom filter leaves nothing to read
    text, read = _scan(everything.where("Device_ID = 'D002-70'"))
    assert read == 0
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_ids_of_other_files_are_trimmed_before_they_are_compared(spark, tmp_path):
    path = str(tmp_path / "foreign")
    raw = [(" A ", datetime(2024, 1, 1), "normal"), ("A", datetime(2024, 1, 2), "normal"), (None, datetime(2024, 1, 3), "normal"), ("B", None, "normal")]
    spark.createDataFrame(raw, "Device_ID string, timestamp timestamp_ntz, primary_label_reported string").write.parquet(path)
    assert read_telemetry(spark, path, format="parquet", devices=["A"]).count() == 2
    assert read_telemetry(spark, path, format="parquet", devices=["nan"]).count() == 1
    assert read_telemetry(spark, path, format="parquet", between=("2024-01-02", "2024-01-03")).count() == 1
    layout = str(tmp_path / "layout")
    write_telemetry(read_telemetry(spark, path, format="parquet"), layout, partitions=2)
    again = read_telemetry(spark, layout, format="parquet", devices=["A", "nan"])
    assert sorted(r["Device_ID"] for r in again.collect()) == ["A", "A", "nan"]
    assert not has_gps(again)


def test_lost_cells_are_counted_in_one_pass(spark, tmp_path):
    header = "Device_ID,timestamp,primary_label_reported,temp_reported,cvss,tamper_reported\n"
    lines = "A,2024-01-01,normal,4.5,NaN,1.0\nA,never,normal,cold,,0.5\n,2024-01-02,normal, ,nan,x\nB,2024-01-03,,5,1e3,\n"
    path = _write(tmp_path / "t.csv", header + lines)
    seen = Observation("typing")
    typed = read_telemetry(spark, path, observation=seen)
    assert typed.count() == 4
    counts = {r["column"]: (r["lost"], r["rows"]) for r in loss_report(spark, seen).collect()}
    assert counts == {"Device_ID": (1, 4), "timestamp": (1, 4), "temp_reported": (1, 4), "cvss": (0, 4), "tamper_reported": (2, 4)}
    raw = spark.read.csv(path, header=True)
    kept = {tuple(r["lost"]): r["temp_reported"] for r in quarantined(raw).collect()}
    assert kept == {("timestamp", "temp_reported", "tamper_reported"): "cold", ("Device_ID", "tamper_reported"): " "}


def test_nothing_is_lost_from_typed_telemetry(spark, sf_dir):
    telemetry = fixture.telemetry(spark, sf_dir)
    assert quarantined(telemetry).count() == 0
    seen = Observation("typing")
    assert normalise(telemetry.limit(0), observation=seen).count() == 0
    assert {r["lost"] for r in loss_report(spark, seen).collect()} == {0}
