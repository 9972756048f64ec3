"""Detectors that are saved in one session and used in another."""

import os

import pytest
from pyspark.sql import functions as F

from frostline.operators.learning.saved import load_detectors, save_detectors, saved_versions
from frostline.operators.features import engineer_features
from frostline.operators.storage import materialise
from frostline.plans import fixture, runs
from frostline.settings import BoostPolicy, DecisionConfig, Persistence
from frostline.sources import daily, results

TINY = BoostPolicy(operational_iterations=2, attack_iterations=2, max_depth=3, calibration_digits=3)


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    return runs.train_detectors(fixture.telemetry(spark, sf_dir), TINY)


SCORES = ["score_temp", "score_geo", "score_tamper", "score_attack_sup"]


def test_another_session_scores_the_same(spark, sf_dir, trained, tmp_path):
    base = str(tmp_path)
    persistence = Persistence(temp=2, attack=3)
    assert save_detectors(spark, trained, base, persistence, "first") == 1
    rows = materialise(engineer_features(fixture.telemetry(spark, sf_dir)))
    expected = sorted(tuple(r) for r in trained.score(rows).select("event_id", *SCORES).collect())

    other = spark.newSession()
    loaded = load_detectors(other, base)
    assert (loaded.version, loaded.persistence, loaded.notes) == (1, persistence, "first")
    assert loaded.detectors.thresholds == trained.thresholds
    assert loaded.detectors.operational["temp"].digits == 3
    again = loaded.detectors.score(other.read.schema(rows.schema).parquet(*rows.inputFiles()))
    assert sorted(tuple(r) for r in again.select("event_id", *SCORES).collect()) == expected


def test_versions_are_kept(spark, trained, tmp_path):
    base = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        load_detectors(spark, base)
    for number in (1, 2):
        assert save_detectors(spark, trained, base, Persistence(temp=number)) == number
    assert load_detectors(spark, base).persistence.temp == 2
    assert load_detectors(spark, base, 1).persistence.temp == 1
    with pytest.raises(FileNotFoundError, match="version 3"):
        load_detectors(spark, base, 3)
    assert saved_versions(spark, base).count() == 2


def test_an_unfinished_save_is_not_seen(spark, trained, tmp_path, monkeypatch):
    """A run that ends before the manifest leaves the older version in force."""
    base = str(tmp_path)
    save_detectors(spark, trained, base)
    monkeypatch.setattr("frostline.operators.learning.saved.saved_versions", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        save_detectors(spark, trained, base)
    monkeypatch.undo()
    assert len([f for f in os.listdir(base) if f != "manifest"]) == 2
    assert load_detectors(spark, base).version == 1


def test_new_telemetry_day_by_day_without_training(spark, sf_dir, tmp_path, monkeypatch):
    telemetry, posture = str(tmp_path / "telemetry"), str(tmp_path / "posture")
    reports = fixture.telemetry(spark, sf_dir)
    reports.write.parquet(telemetry)
    fixture.posture(spark, sf_dir).selectExpr("*", "0 AS nist_gap_count").write.csv(posture, header=True)
    models, out = str(tmp_path / "models"), str(tmp_path / "out")
    config = DecisionConfig(persistence=Persistence(temp=2))
    version = runs.train_and_save(spark, telemetry, models, format="parquet", policy=TINY, config=config)

    monkeypatch.setattr(runs, "train_detectors", lambda *_, **__: 1 / 0)
    middle = F.lit("2024-01-10").cast("date")
    for n, side in enumerate((F.to_date("timestamp") < middle, F.to_date("timestamp") >= middle)):
        part = str(tmp_path / f"part{n}")
        reports.where(side).write.parquet(part)
        run = runs.alert_with_saved(spark, part, posture, models, out, format="parquet")
        assert run.detectors.thresholds == load_detectors(spark, models, version).detectors.thresholds
    saved = results.read_results(spark, out)
    assert saved[results.PREDICTIONS].count() == reports.count()
    assert saved[results.DASHBOARD].count() == daily.dashboard(spark, out).count()
    assert saved[results.DASHBOARD].count() == reports.selectExpr("Device_ID", "to_date(timestamp)").distinct().count()
    assert results.decision_config(saved[results.METADATA]).persistence.temp == 2


def test_settings_from_metadata(spark):
    meta = spark.createDataFrame(
        [({"temp": 7, "unknown": 1}, {"geo": 0.25}, None, None)], results.METADATA_SCHEMA
    )
    config = results.decision_config(meta)
    assert (config.persistence.temp, config.persistence.geo) == (7, 4)
    assert (config.thresholds.geo, config.thresholds.tamper) == (0.25, 1.0)
    assert results.decision_config(meta.limit(0)) == DecisionConfig()
