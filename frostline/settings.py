"""Column names, fixed values and tunable parameters.

Everything that must agree with published results (labels, weights, limits,
feature lists) sits here as plain text; code elsewhere refers to it by name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

DEVICE = "Device_ID"
RECEIVED = "timestamp"
REPORTED = "timestamp_reported"
LABEL = "primary_label_reported"
ROW_ID = "event_id"

# ---- fixed values: labels -------------------------------------------------
NORMAL = "normal"
STORAGE = "Loss_of_storage_condition"
GEOFENCE = "Geofence_anomaly"
TAMPER = "Tamper_Damage_anomaly"
CYBER = "Cyberattack_anomaly"
OPERATIONAL_LABELS = (STORAGE, GEOFENCE, TAMPER)
LABELS = (NORMAL, STORAGE, GEOFENCE, TAMPER, CYBER)

# ---- fixed values: candidates for an operational label ---------------------
CANDIDATES = (
    (STORAGE, "pred_temp_bin", "score_temp"),
    (GEOFENCE, "pred_geo_bin", "score_geo"),
    (TAMPER, "pred_tamper_bin", "score_tamper"),
)

# ---- fixed values: actions ------------------------------------------------
ISOLATE = "ISOLATE_DEVICE"
RECOVER = "PRIORITY_RECOVERY"
PATCH = "PATCH_AND_MONITOR"
MONITOR = "MONITOR"

# ---- fixed values: input columns ------------------------------------------
REQUIRED_COLUMNS = (DEVICE, RECEIVED, LABEL)
POSTURE_MEASURES = ("cvss", "epss", "dvd")
SENSOR_MEASURES = (
    "temp_reported",
    "humidity_reported",
    "distance_from_route_reported",
    "lat_reported",
    "lon_reported",
)
INTEGER_FLAGS = ("tamper_reported", "is_augmented")
PREDICTION_COLUMNS = (
    "Device_ID",
    "timestamp",
    "primary_label_reported",
    "operational_label",
    "op_best_score",
    "score_attack_sup",
    "pred_attack_bin",
    "recommended_action",
)

# ---- fixed values: model feature lists ------------------------------------
TEMP_FEATURES = (
    "temp_reported",
    "temp_roll_mean_3",
    "temp_roll_std_3",
    "temp_roll_std_5",
    "delta_temp",
    "temp_resid",
)
GEO_FEATURES = (
    "distance_from_route_reported",
    "dist_roll_max_5",
    "delta_dist",
    "gps_repeat_count",
)
TAMPER_FEATURES = (
    "tamper_reported",
    "delta_temp",
    "temp_roll_std_3",
    "distance_from_route_reported",
)
ATTACK_FEATURES = (
    "reported_ts_diff_min",
    "rpt_gap_min",
    "rcv_gap_min",
    "gap_err_min",
    "rpt_gap_cv_5",
    "rcv_gap_cv_5",
    "delay_min",
    "delay_z",
    "delay_big",
    "gps_repeat_count",
    "gps_repeat_cap10",
    "dup_ratio_5",
    "dup_ratio_10",
    "temp_var_5",
    "hum_var_5",
    "zcr_temp_5",
    "zcr_hum_5",
    "temp_resid_std_ratio",
    "hum_resid_std_ratio",
    "rpt_ooo",
    "speed_mean_5",
    "speed_std_5",
    "accel_std_5",
    "teleport_flag",
)
TELEMETRY_FEATURES = (
    "temp_reported",
    "humidity_reported",
    "distance_from_route_reported",
)
FUSION_FEATURES = TELEMETRY_FEATURES + ("cvss_used", "epss_used", "dvd_used")

# ---- fixed values: physics and feature limits -----------------------------
EARTH_RADIUS_M = 6371000.0
TELEPORT_MPS = 60.0
DELAY_BIG_MIN = 5.0
EPSILON = 1e-6
RUN_CAP = 10
EWMA_SPAN = 5


@dataclass(frozen=True)
class Persistence:
    """Consecutive raw flags a detector needs before it alerts."""

    temp: int = 4
    geo: int = 4
    tamper: int = 1
    attack: int = 2


@dataclass(frozen=True)
class Thresholds:
    """Score cut per detector; the defaults are the published ones."""

    temp: float = 0.34829059829059833
    geo: float = 0.7367276926872278
    tamper: float = 1.0
    attack_sup_base: float = 0.44645437053393533


@dataclass(frozen=True)
class RiskPolicy:
    """How device posture moves the attack threshold."""

    epss_weight: float = 0.15
    cvss_weight: float = 0.35
    dvd_weight: float = 0.05
    term_max: float = 0.7
    threshold_min: float = 0.10
    threshold_max: float = 0.90
    high_epss: float = 0.60
    high_cvss: float = 8.0
    risk_aware: bool = True


@dataclass(frozen=True)
class ActionPolicy:
    isolate_below_score: float = 0.5
    patch_from_cvss: float = 7.0
    epss_weight: float = 0.5
    cvss_weight: float = 0.3
    dvd_weight: float = 0.2


@dataclass(frozen=True)
class BumpPolicy:
    """Posture increase earned by observed anomalies."""

    epss_per_day: float = 0.02
    epss_per_hit: float = 0.0005
    epss_bump_max: float = 0.25
    dvd_per_day: float = 0.05
    dvd_bump_max: float = 0.5
    cvss_bump: float = 0.5
    cvss_below: float = 7.0
    cvss_min_days: int = 3
    cvss_max: float = 10.0
    epss_max: float = 1.0
    dvd_max: float = 10.0


@dataclass(frozen=True)
class SweepBetas:
    temp: float = 1.3
    geo: float = 1.3
    tamper: float = 2.0
    attack: float = 1.0


@dataclass(frozen=True)
class BoostPolicy:
    """Gradient-boosted tree settings shared by the detectors."""

    operational_iterations: int = 300
    attack_iterations: int = 400
    attack_weight: float = 3.0
    max_depth: int = 5
    step_size: float = 0.1
    max_bins: int = 255
    min_instances: int = 20
    folds: int = 3
    seed: int = 42
    # share of the training rows that is held back to stop early; 0 trains on all
    held_back: float = 0.0
    # decimal places that scores are pooled at before calibration; None: exact
    calibration_digits: int | None = None


@dataclass(frozen=True)
class DecisionConfig:
    persistence: Persistence = field(default_factory=Persistence)
    thresholds: Thresholds = field(default_factory=Thresholds)
    risk: RiskPolicy = field(default_factory=RiskPolicy)
    actions: ActionPolicy = field(default_factory=ActionPolicy)
