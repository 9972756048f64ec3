from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.operators import decisions
from frostline.operators.decisions import decide, decide_laid_out
from frostline.operators.series import SplitPolicy, lay_out
from frostline.settings import DecisionConfig, RiskPolicy, Thresholds

COLUMNS = (
    "Device_ID string, timestamp timestamp_ntz, event_id long, score_temp double,"
    " score_geo double, score_tamper double, score_attack_sup double, tamper_reported int,"
    " cvss double, epss double, dvd double"
)
CONFIG = DecisionConfig(thresholds=Thresholds(0.5, 0.5, 1.0, 0.45))


def _rows(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = dict(device="A", temp=0.0, geo=0.0, tamper=0.0, attack=0.0, reported=0, cvss=1.0, epss=0.1, dvd=0.0) | r
        full.append(
            (d["device"], datetime(2024, 1, 1) + timedelta(minutes=i), i, d["temp"], d["geo"],
             d["tamper"], d["attack"], d["reported"], d["cvss"], d["epss"], d["dvd"])
        )
    return spark.createDataFrame(full, COLUMNS)


def _column(df, name):
    return [r[name] for r in df.orderBy("event_id").select(name).collect()]


def test_persistence_needs_consecutive_flags(spark):
    scores = [1, 1, 1, 1, 0, 1, 1]
    df = decide(_rows(spark, [dict(temp=float(s), attack=float(s)) for s in scores]), CONFIG)
    assert _column(df, "pred_temp_bin") == [0, 0, 0, 1, 0, 0, 0]
    assert _column(df, "pred_attack_bin") == [0, 1, 1, 1, 0, 0, 1]


def test_runs_do_not_cross_devices(spark):
    rows = [dict(device="A", temp=1.0)] * 3 + [dict(device="B", temp=1.0)] * 4
    assert _column(decide(_rows(spark, rows), CONFIG), "pred_temp_bin") == [0] * 6 + [1]


def test_high_risk_rows_alert_at_once(spark):
    rows = [dict(attack=1.0, epss=0.6), dict(attack=0.0), dict(attack=1.0, cvss=8.0), dict(attack=1.0)]
    df = decide(_rows(spark, rows), CONFIG)
    assert _column(df, "pred_attack_bin") == [1, 0, 1, 1]


def test_missing_posture_is_low_risk(spark):
    df = decide(_rows(spark, [dict(attack=0.46, cvss=None, epss=None, dvd=None)] * 2), CONFIG)
    assert _column(df, "high_risk") == [False, False]
    assert _column(df, "thr_attack") == [0.45, 0.45]
    assert _column(df, "recommended_action") == ["MONITOR", "ISOLATE_DEVICE"]


def test_equal_scores_prefer_storage_then_geofence(spark):
    rows = [dict(temp=1.0, geo=1.0, tamper=1.0)] * 4
    assert _column(decide(_rows(spark, rows), CONFIG), "operational_label")[-1] == S.STORAGE
    rows = [dict(temp=0.0, geo=1.0, tamper=1.0)] * 4
    assert _column(decide(_rows(spark, rows), CONFIG), "operational_label")[-1] == S.GEOFENCE


def test_reported_tamper_overrides_a_zero_score(spark):
    df = decide(_rows(spark, [dict(reported=1)]), CONFIG)
    row = df.first()
    assert (row["operational_label"], row["op_best_score"]) == (S.TAMPER, 0.0)


@pytest.mark.parametrize(
    "row, action",
    [
        (dict(attack=1.0, epss=0.9), S.ISOLATE),
        (dict(attack=1.0, epss=0.9, reported=1, tamper=0.9, cvss=7.0), S.PATCH),
        (dict(reported=1, tamper=0.9, cvss=6.9), S.MONITOR),
        (dict(reported=1, tamper=0.2, cvss=9.0, attack=0.9), S.ISOLATE),
        (dict(), S.MONITOR),
    ],
)
def test_actions(spark, row, action):
    assert decide(_rows(spark, [row]), CONFIG).first()["recommended_action"] == action


def test_storage_loss_is_recovered(spark):
    df = decide(_rows(spark, [dict(temp=1.0, cvss=9.0)] * 4), CONFIG)
    assert _column(df, "recommended_action")[-1] == S.RECOVER


def test_risk_awareness_only_lowers_the_threshold(spark):
    postures = [dict(cvss=c / 2, epss=c / 20, dvd=c / 10) for c in range(21)]
    df = _rows(spark, postures).withColumn("cut", F.expr(decisions.attack_threshold(0.45)))
    cuts = _column(df, "cut")
    assert max(cuts) <= 0.45 and min(cuts) >= 0.10 and cuts == sorted(cuts, reverse=True)


def test_ablation_keeps_the_base_unclipped(spark):
    config = replace(CONFIG, risk=RiskPolicy(risk_aware=False), thresholds=Thresholds(0.5, 0.5, 1.0, 0.95))
    assert _column(decide(_rows(spark, [dict(cvss=9.0)]), config), "thr_attack") == [0.95]


@pytest.mark.parametrize(
    "cvss, epss, dvd, risk",
    [(1.584, 0.0263, 4.0, 0.86067), (1.698, 0.1071, 2.0, 0.50449), (3.485, 0.0285, 3.0, 0.7188)],
)
def test_combined_risk_of_published_device_days(spark, cvss, epss, dvd, risk):
    row = decide(_rows(spark, [dict(cvss=cvss, epss=epss, dvd=dvd)]), CONFIG).first()
    assert row["risk_score_combined"] == pytest.approx(risk, abs=1e-12)


@pytest.mark.parametrize("policy", [SplitPolicy(), SplitPolicy(max_rows=40), SplitPolicy(max_rows=2)])
def test_decisions_on_rows_laid_out_already(spark, policy):
    rng = np.random.default_rng(4)
    kinds = ("temp", "geo", "tamper", "attack")
    rows = [
        {k: float(rng.random() < 0.8) for k in kinds}
        | {"device": "ABC"[min(int(rng.integers(0, 6)), 2)], "cvss": float(rng.integers(6, 10)), "reported": int(rng.random() < 0.1)}
        for _ in range(300)
    ]
    df = _rows(spark, rows)
    g = lay_out(df, [S.DEVICE], (S.RECEIVED, S.ROW_ID), policy=policy)
    assert g.split == (policy.max_rows < 300)
    found, expected = decide_laid_out(g.own_rows(*df.columns), CONFIG), decide(df, CONFIG)
    assert found.columns == expected.columns
    assert sorted(found.collect()) == sorted(expected.collect())
    held = expected.agg(*[F.sum(f"pred_{k}_bin") for k in kinds]).first()
    assert all(0 < n < 300 for n in held)
