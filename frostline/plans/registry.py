"""Every query by name: how Spark runs it, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.functions import expressions as X
from frostline.operators import cells, decisions, evaluate, features, rollups, sketched, split
from frostline.operators.learning.boost import OPERATIONAL, fit_attack, fit_operational
from frostline.operators.learning.detectors import fit_detectors
from frostline.operators.learning.forest import fit_forest
from frostline.operators.learning.fusion import fit_fusion
from frostline.operators.learning.matrix import Scaling, stratified_folds
from frostline.operators.learning.saved import load_detectors, save_detectors
from frostline.operators.lookups import attach_per_device, replace_posture
from frostline.operators.series import SplitPolicy
from frostline.operators.storage import materialise, new_path
from frostline.plans import fixture, oracle, runs
from frostline.plans.shapes import SINGLE, Shape, exact, present, present_sql, rounded
from frostline.settings import BoostPolicy, DecisionConfig, RiskPolicy, SweepBetas
from frostline.sources import daily, results
from frostline.sources import telemetry as source

CONFIG = DecisionConfig(thresholds=fixture.FIXTURE_THRESHOLDS)

# splits every fixture device into many pieces, so that the plan for very long
# series is held against the same SQL as the plain one
MANY_PIECES = SplitPolicy(max_rows=90, max_pieces=64)

# few rounds keep the registered training queries short, and their results say
# so in `rounds` and `depth`; the library default is the published 300 and 400
# rounds of depth 5
SHORT_BOOST = BoostPolicy(operational_iterations=5, attack_iterations=5, max_depth=4)

ONE_TREE = BoostPolicy(operational_iterations=1, attack_iterations=1, max_depth=2)

KEYS = exact(S.DEVICE, S.RECEIVED, S.ROW_ID)


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    shape: Shape
    ctes: str | None = None
    relation: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(self.build(spark, sf_dir), self.shape)

    def sql(self) -> str | None:
        if self.ctes is None:
            return None
        return present_sql(self.shape, self.ctes, self.relation)


QUERIES: dict[str, Query] = {}


def _register(name: str, build, shape: Shape, ctes: str | None = None, relation: str = ""):
    QUERIES[name] = Query(build, shape, ctes, relation)


# -- inputs shared by the queries ------------------------------------------------
def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decide(fixture.scored_telemetry(spark, sf_dir), CONFIG)


def _on_decided(step: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: step(_decided(spark, sf_dir))


def _on_telemetry(step: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: step(fixture.telemetry(spark, sf_dir))


def _on_scored(step: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: step(fixture.scored_telemetry(spark, sf_dir))


def _on_dashboard(step: Callable[[DataFrame], DataFrame]):
    return _on_decided(lambda df: step(rollups.risk_dashboard(df)))


def _on_posture(step: Callable[[DataFrame], DataFrame]):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        update = rollups.update_posture(
            fixture.posture(spark, sf_dir), _decided(spark, sf_dir)
        )
        return step(update)

    return build


# -- sources ----------------------------------------------------------------------
TELEMETRY_SHAPE = exact(
    S.DEVICE, S.RECEIVED, S.REPORTED, *S.SENSOR_MEASURES, *S.INTEGER_FLAGS,
    S.LABEL, *S.POSTURE_MEASURES, S.ROW_ID,
)
_register(
    "telemetry_scan", fixture.telemetry, TELEMETRY_SHAPE, oracle.TELEMETRY, "scored"
)


def _as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a loosely typed export: padded ids, text times of which
    some are broken, most optional columns absent."""
    events = fixture.table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    return events.select(
        F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("  "), "user_id", F.lit(" "))).alias(S.DEVICE),
        F.when(F.col("event_id") % 11 == 0, F.lit("unknown")).otherwise(stamp).alias(S.RECEIVED),
        F.col("event_type").alias(S.LABEL),
        F.when(F.col("event_id") % 17 == 0, F.lit("n/a"))
        .otherwise(F.col("value").cast("string"))
        .alias("temp_reported"),
        F.when(F.col("event_id") % 5 == 0, F.lit("NaN")).otherwise(F.lit("1.5")).alias("cvss"),
        F.col("event_id").alias(S.ROW_ID),
    )


_register(
    "telemetry_normalised",
    lambda spark, sf_dir: source.normalise(
        _as_text(spark, sf_dir), timestamp_pattern="dd/MM/yyyy HH:mm:ss"
    ),
    TELEMETRY_SHAPE,
    """
normalised AS (
  SELECT coalesce(CASE WHEN event_id % 13 <> 0 THEN CAST(user_id AS VARCHAR) END, 'nan')
      AS "Device_ID",
    CASE WHEN event_id % 11 <> 0 THEN date_trunc('second', ts) END AS "timestamp",
    CAST(NULL AS TIMESTAMP) AS timestamp_reported,
    CASE WHEN event_id % 17 <> 0 THEN value END AS temp_reported,
    0e0 AS humidity_reported, 0e0 AS distance_from_route_reported,
    0e0 AS lat_reported, 0e0 AS lon_reported,
    0 AS tamper_reported, 0 AS is_augmented, event_type AS primary_label_reported,
    CASE WHEN event_id % 5 <> 0 THEN 1.5e0 END AS cvss, 0e0 AS epss, 0e0 AS dvd, event_id
  FROM events
)""",
    "normalised",
)
_register(
    "feature_availability",
    _on_telemetry(source.feature_availability),
    exact("gps", "timestamp_reported", "tamper_reported"),
    oracle.TELEMETRY,
    """(SELECT true AS gps, bool_or(timestamp_reported IS NOT NULL) AS timestamp_reported,
        true AS tamper_reported FROM scored)""",
)


# -- what a user keeps in files: written from the given tables, read back ------------
def _telemetry_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV export with decimal flags and without positions."""
    path = new_path(spark, "telemetry-csv")
    rows = fixture.telemetry(spark, sf_dir).drop("lat_reported", "lon_reported")
    flags = {c: F.col(c).cast("double") for c in S.INTEGER_FLAGS}
    as_text = {c: F.col(c).cast("string") for c in (S.RECEIVED, S.REPORTED)}
    rows.withColumns(flags | as_text).write.csv(path, header=True)
    back = source.read_telemetry(spark, path)
    return back.withColumn(S.ROW_ID, F.col(S.ROW_ID).cast("long"))


def _posture_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "posture-csv")
    columns = [f.name for f in results.POSTURE_SCHEMA.fields[:-1]]
    rows = fixture.posture(spark, sf_dir).select(*columns, F.lit(0).alias("nist_gap_count"))
    rows.write.csv(path, header=True)
    return results.read_posture(spark, path)


def _predictions_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "predictions")
    results.write_predictions(_decided(spark, sf_dir), path)
    return results.read_predictions(spark, path)


def _dashboard_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "dashboard")
    results.write_dashboard(rollups.risk_dashboard(_decided(spark, sf_dir)), path, format="csv")
    return results.read_results(spark, path, format="csv")[results.DASHBOARD]


def _posture_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "posture")
    initial = fixture.posture(spark, sf_dir)
    results.write_posture(initial, rollups.update_posture(initial, _decided(spark, sf_dir)), path)
    return results.read_results(spark, path)[results.FINAL_POSTURE]


_register(
    "telemetry_csv",
    _telemetry_csv,
    TELEMETRY_SHAPE,
    oracle.TELEMETRY,
    "(SELECT * REPLACE (0e0 AS lat_reported, 0e0 AS lon_reported) FROM scored)",
)
_register(
    "posture_csv",
    _posture_csv,
    exact(S.DEVICE, *S.POSTURE_MEASURES),
    oracle.DAYS,
    "posture",
)
_register(
    "posture_scan",
    fixture.posture,
    exact(S.DEVICE, *S.POSTURE_MEASURES),
    oracle.DAYS,
    "posture",
)


def _layout_path(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "telemetry-layout")
    source.write_telemetry(fixture.telemetry(spark, sf_dir), path, partitions=8)
    return path


_register(
    "telemetry_layout",
    lambda spark, sf_dir: source.read_telemetry(
        spark, _layout_path(spark, sf_dir), format="parquet"
    ),
    TELEMETRY_SHAPE,
    oracle.TELEMETRY,
    "scored",
)
_register(
    "device_from_layout",
    lambda spark, sf_dir: source.read_telemetry(
        spark,
        _layout_path(spark, sf_dir),
        format="parquet",
        devices=["D002", "D007"],
        between=("2024-01-05", "2024-01-12 12:00:00"),
    ),
    TELEMETRY_SHAPE,
    oracle.TELEMETRY,
    """(SELECT * FROM scored WHERE "Device_ID" IN ('D002', 'D007')
        AND "timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" < TIMESTAMP '2024-01-12 12:00:00')""",
)


def _lost_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted in the pass that writes the typed table."""
    seen = Observation("typing")
    materialise(
        source.normalise(
            _as_text(spark, sf_dir), timestamp_pattern="dd/MM/yyyy HH:mm:ss", observation=seen
        )
    )
    return source.loss_report(spark, seen)


_register(
    "lost_cells",
    _lost_cells,
    exact("column", "lost", "rows"),
    """
counted AS (
  SELECT unnest(['Device_ID', 'timestamp', 'temp_reported', 'cvss']) AS "column",
    unnest([count(*) FILTER (event_id % 13 = 0), count(*) FILTER (event_id % 11 = 0),
      count(*) FILTER (event_id % 17 = 0), 0]) AS lost,
    unnest([count(*), count(*), count(*), count(*)]) AS "rows"
  FROM events
)""",
    "counted",
)
_register(
    "quarantined_rows",
    lambda spark, sf_dir: source.quarantined(
        _as_text(spark, sf_dir), timestamp_pattern="dd/MM/yyyy HH:mm:ss"
    ).withColumn("lost", F.array_join("lost", ",")),
    exact(S.DEVICE, S.RECEIVED, "temp_reported", S.ROW_ID, "lost"),
    """
held AS (
  SELECT CASE WHEN event_id % 13 <> 0 THEN '  ' || user_id || ' ' END AS "Device_ID",
    CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END AS "timestamp",
    CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS temp_reported,
    event_id,
    concat_ws(',', CASE WHEN event_id % 13 = 0 THEN 'Device_ID' END,
      CASE WHEN event_id % 11 = 0 THEN 'timestamp' END,
      CASE WHEN event_id % 17 = 0 THEN 'temp_reported' END) AS lost
  FROM events
)""",
    "(SELECT * FROM held WHERE lost <> '')",
)

# -- projections and filters ---------------------------------------------------------
_register(
    "haversine_distance",
    _on_telemetry(
        lambda df: df.withColumn(
            "metres",
            F.expr(X.great_circle_m("40.7D", "-73.9D", "lat_reported", "lon_reported")),
        )
    ),
    KEYS | rounded(["metres"]),
    oracle.TELEMETRY,
    """(SELECT *, 2e0 * 6371000e0 * asin(sqrt(
          pow(sin(radians(lat_reported - 40.7e0) / 2e0), 2e0)
          + cos(radians(40.7e0)) * cos(radians(lat_reported))
            * pow(sin(radians(lon_reported + 73.9e0) / 2e0), 2e0))) AS metres FROM scored)""",
)
_register(
    "content_key",
    _on_telemetry(
        lambda df: df.withColumns(
            {
                "content_key": F.expr(
                    X.content_key(
                        "lat_reported", "lon_reported", "temp_reported", "humidity_reported"
                    )
                ),
                "value_1dp": F.expr(X.round_half_even("distance_from_route_reported", 1)),
            }
        )
    ),
    KEYS | exact("content_key", "value_1dp"),
    oracle.TELEMETRY,
    """(SELECT *, coalesce(CAST(round_even(lat_reported, 5) AS VARCHAR), 'nan') || '|'
          || coalesce(CAST(round_even(lon_reported, 5) AS VARCHAR), 'nan') || '|'
          || coalesce(CAST(round_even(temp_reported, 1) AS VARCHAR), 'nan') || '|'
          || coalesce(CAST(round_even(humidity_reported, 1) AS VARCHAR), 'nan') AS content_key,
          round_even(distance_from_route_reported, 1) AS value_1dp
        FROM scored)""",
)
_register(
    "binary_targets",
    _on_telemetry(split.add_targets),
    KEYS | exact(*split.TARGETS),
    oracle.TELEMETRY,
    """(SELECT *, CAST(primary_label_reported = 'Loss_of_storage_condition' AS INTEGER) AS y_temp,
          CAST(primary_label_reported = 'Geofence_anomaly' AS INTEGER) AS y_geo,
          CAST(primary_label_reported = 'Tamper_Damage_anomaly' AS INTEGER) AS y_tamper,
          CAST(primary_label_reported = 'Cyberattack_anomaly' AS INTEGER) AS y_attack
        FROM scored)""",
)
_register(
    "label_classes",
    _on_telemetry(
        lambda df: df.withColumns(
            {
                "operational_class": F.expr(X.operational_class(S.LABEL)),
                "is_anomaly": F.expr(X.is_anomaly(S.LABEL)),
                "is_cyber_true": F.expr(X.is_label(S.LABEL, S.CYBER)),
            }
        )
    ),
    KEYS | exact("operational_class", "is_anomaly", "is_cyber_true"),
    oracle.TELEMETRY,
    """(SELECT *, CASE WHEN primary_label_reported = 'Cyberattack_anomaly' THEN 'normal'
            ELSE primary_label_reported END AS operational_class,
          CAST(primary_label_reported <> 'normal' AS INTEGER) AS is_anomaly,
          CAST(primary_label_reported = 'Cyberattack_anomaly' AS INTEGER) AS is_cyber_true
        FROM scored)""",
)
_register(
    "attack_training_rows",
    _on_telemetry(lambda df: split.without_augmented(split.attack_rows(df))),
    KEYS | exact(S.LABEL, "is_augmented"),
    oracle.TELEMETRY,
    """(SELECT * FROM scored WHERE is_augmented = 0
          AND primary_label_reported IN ('normal', 'Cyberattack_anomaly'))""",
)
_register(
    "day_and_hour",
    _on_telemetry(
        lambda df: df.withColumns(
            {
                "date": F.to_date(S.RECEIVED),
                "hour": F.expr(X.hour_of(S.RECEIVED)),
            }
        )
    ),
    KEYS | exact("date", "hour"),
    oracle.TELEMETRY,
    """(SELECT *, CAST("timestamp" AS DATE) AS date, date_trunc('hour', "timestamp") AS hour
        FROM scored)""",
)
_register(
    "zero_filled_features",
    _on_telemetry(
        lambda df: df.withColumns(
            {c: F.expr(X.zero_if_null(c)) for c in ("temp_reported", "humidity_reported")}
        )
    ),
    KEYS | exact("temp_reported", "humidity_reported"),
    oracle.TELEMETRY,
    """(SELECT * REPLACE (coalesce(temp_reported, 0e0) AS temp_reported) FROM scored)""",
)
_register(
    "first_ten_devices",
    lambda spark, sf_dir: rollups.select_devices(
        fixture.findings(spark, sf_dir), default_first=10
    ),
    exact(S.DEVICE, "vuln_id", "cvss", "epss"),
    oracle.FINDINGS,
    """(SELECT * FROM findings WHERE "Device_ID" IN
          (SELECT DISTINCT "Device_ID" FROM findings ORDER BY 1 LIMIT 10))""",
)
_register(
    "device_timeline",
    _on_decided(lambda df: rollups.device_timeline(df, "D003")),
    KEYS | exact("score_attack_sup", "pred_attack_bin"),
    oracle.DECIDED,
    """(SELECT * FROM decided WHERE "Device_ID" = 'D003')""",
)
_register(
    "flagged_rows",
    _on_decided(rollups.flagged),
    KEYS | exact("score_attack_sup"),
    oracle.DECIDED,
    "(SELECT * FROM decided WHERE pred_attack_bin > 0)",
)
_register(
    "unit_predictions",
    _on_scored(
        lambda df: df.withColumn(
            "prediction", F.expr(X.unit_flag("temp_reported - 2D"))
        )
    ),
    KEYS | exact("prediction"),
    oracle.TELEMETRY,
    """(SELECT *, least(1, greatest(0, coalesce(CAST(trunc(temp_reported - 2e0) AS INTEGER), 0)))
          AS prediction FROM scored)""",
)

# -- features ---------------------------------------------------------------------------
TIMING_SHAPE = (
    KEYS
    | exact("delay_min", "delay_big", "rpt_gap_min", "rcv_gap_min", "rpt_ooo", "delay_med_1h")
    | exact("gap_err_min", "reported_ts_diff_min")
    | rounded(["delay_std_1h"])
    | rounded(["delay_z", "rpt_gap_cv_5", "rcv_gap_cv_5"], 4)
)
SENSOR_SHAPE = KEYS | {
    c: None if c.startswith(("dist_roll", "delta")) else 6 for c in features.SENSOR
}
SMOOTHED_SHAPE = (
    KEYS
    | rounded(["temp_resid", "hum_resid"])
    | rounded(["temp_resid_std_ratio", "hum_resid_std_ratio"], 4)
)
KINEMATIC_SHAPE = KEYS | {
    c: None if c == "teleport_flag" else 6 for c in features.KINEMATIC
}
REPLAY_SHAPE = KEYS | exact("dup_flag") | rounded(["dup_ratio_5", "dup_ratio_10"])
GPS_SHAPE = KEYS | exact(*features.GPS)

_FEATURE_QUERIES = {
    "timing": (TIMING_SHAPE, oracle.TELEMETRY + "," + oracle.timing(), "timing"),
    "gps": (
        GPS_SHAPE,
        oracle.TELEMETRY + "," + oracle.GPS,
        "(SELECT *, least(gps_repeat_count, 10) AS gps_repeat_cap10 FROM gps)",
    ),
    "sensor": (SENSOR_SHAPE, oracle.TELEMETRY + "," + oracle.sensor(), "sensor"),
    "smoothed": (SMOOTHED_SHAPE, oracle.smoothed(), "smoothed"),
    "kinematic": (
        KINEMATIC_SHAPE,
        oracle.TELEMETRY + "," + oracle.kinematic(),
        "kinematic",
    ),
    "replay": (REPLAY_SHAPE, oracle.TELEMETRY + "," + oracle.replay(), "replay"),
}


def _family(name: str, policy: SplitPolicy | None = None):
    options = {} if policy is None else {"policy": policy}
    return _on_telemetry(
        lambda df: features.engineer_features(df, [name], **options)
    )


for _name, (_shape, _ctes, _relation) in _FEATURE_QUERIES.items():
    _register(f"{_name}_features", _family(_name), _shape, _ctes, _relation)
    _register(
        f"{_name}_features_long_series",
        _family(_name, MANY_PIECES),
        _shape,
        _ctes,
        _relation,
    )

_register(
    "features_without_gps",
    _on_telemetry(
        lambda df: features.engineer_features(
            df, ["gps", "kinematic", "replay"], gps=False
        )
    ),
    GPS_SHAPE | KINEMATIC_SHAPE | REPLAY_SHAPE,
    oracle.TELEMETRY + "," + oracle.replay(gps=False),
    "(SELECT *, "
    + ", ".join(
        f"{'0' if c in (*features.GPS, 'teleport_flag') else '0e0'} AS {c}"
        for c in features.GPS + features.KINEMATIC
    )
    + " FROM replay)",
)
_register(
    "all_features",
    _on_telemetry(features.engineer_features),
    TIMING_SHAPE | GPS_SHAPE | SENSOR_SHAPE | SMOOTHED_SHAPE | KINEMATIC_SHAPE | REPLAY_SHAPE,
    oracle.smoothed()
    + ","
    + oracle.timing()
    + ","
    + oracle.GPS
    + ","
    + oracle.kinematic()
    + ","
    + oracle.replay(),
    "(SELECT *, least(gps_repeat_count, 10) AS gps_repeat_cap10 FROM timing"
    + "".join(
        f" JOIN (SELECT event_id, {', '.join(cols)} FROM {cte}) USING (event_id)"
        for cte, cols in (
            ("gps", ["gps_same", "gps_repeat_count"]),
            ("smoothed", features.SENSOR + features.SMOOTHED),
            ("kinematic", features.KINEMATIC),
            ("replay", features.REPLAY),
        )
    )
    + ")",
)

# -- split ------------------------------------------------------------------------------
_SPLIT_SQL = (
    oracle.TELEMETRY
    + """,
marked AS (
  SELECT *, CAST(row_number() OVER w > greatest(
      floor((1e0 - 0.2e0) * count(*) OVER (PARTITION BY "Device_ID")), 1) AS INTEGER)
    AS is_validation
  FROM scored
  WINDOW w AS (PARTITION BY "Device_ID" ORDER BY "timestamp", event_id)
)"""
)
for _name, _policy in (("", SplitPolicy()), ("_long_series", MANY_PIECES)):
    _register(
        f"validation_split{_name}",
        _on_telemetry(lambda df, p=_policy: split.mark_validation(df, policy=p)),
        KEYS | exact("is_validation"),
        _SPLIT_SQL,
        "marked",
    )


def _stacked_sides(df: DataFrame) -> DataFrame:
    train, held_out = split.train_and_validation(split.mark_validation(df))
    return train.withColumn("side", F.lit("train")).unionByName(
        split.without_augmented(held_out).withColumn("side", F.lit("validation"))
    )


_register(
    "train_and_validation",
    _on_telemetry(_stacked_sides),
    KEYS | exact("side"),
    _SPLIT_SQL,
    """(SELECT *, CASE is_validation WHEN 0 THEN 'train' ELSE 'validation' END AS side
        FROM marked WHERE is_validation = 0 OR is_augmented = 0)""",
)

# -- decisions ------------------------------------------------------------------------------
DECISION_SHAPE = KEYS | exact(
    "pred_temp_bin", "pred_geo_bin", "pred_tamper_bin", "pred_attack_bin",
    "high_risk", "operational_label", "op_best_score", "recommended_action",
) | rounded(["thr_attack", "risk_score_combined"])
_register("decisions", _decided, DECISION_SHAPE, oracle.DECIDED, "decided")


def _daily_runs(spark: SparkSession, sf_dir: str) -> str:
    """Where three runs left their results: even days, odd days, and rows of
    many days that came late, one batch of them twice."""
    path = new_path(spark, "daily")
    decided = materialise(_decided(spark, sf_dir))
    late, odd = F.col(S.ROW_ID) % 29 == 0, F.day(S.RECEIVED) % 2 == 1
    daily.save_days(decided.where(~late & ~odd), path)
    daily.save_days(decided.where(~late & odd), path)
    for _ in range(2):
        daily.add_late(decided.where(late), path)
    return path


def _by_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided with the settings that a run has left."""
    path = new_path(spark, "settings")
    meta = results.metadata(spark, CONFIG.persistence, CONFIG.thresholds)
    results.write_metadata(meta, path)
    config = results.decision_config(results.read_metadata(spark, path))
    return decisions.decide(fixture.scored_telemetry(spark, sf_dir), config)


_register("predictions_saved", _predictions_back, DECISION_SHAPE, oracle.DECIDED, "decided")
_register(
    "predictions_of_daily_runs",
    lambda spark, sf_dir: results.read_predictions(spark, _daily_runs(spark, sf_dir)),
    DECISION_SHAPE,
    oracle.DECIDED,
    "decided",
)
_register(
    "decisions_from_metadata",
    _by_metadata,
    DECISION_SHAPE,
    oracle.DECIDED,
    "decided",
)
_register(
    "decisions_long_series",
    _on_scored(lambda df: decisions.decide(df, CONFIG, policy=MANY_PIECES)),
    DECISION_SHAPE,
    oracle.DECIDED,
    "decided",
)
_register(
    "risk_thresholds",
    _on_scored(
        lambda df: df.withColumns(
            {
                "risk_term": F.expr(decisions.risk_term()),
                "thr_attack": F.expr(decisions.attack_threshold(0.446454)),
                "high_risk": F.expr(decisions.high_risk()),
            }
        )
    ),
    KEYS | rounded(["risk_term", "thr_attack"]) | exact("high_risk"),
    oracle.TELEMETRY + "," + oracle.THRESHOLDS,
    "cuts",
)
_register(
    "ablation_decisions",
    _on_scored(
        lambda df: decisions.decide(
            df, replace(CONFIG, risk=RiskPolicy(risk_aware=False))
        )
    ),
    DECISION_SHAPE,
    oracle.DECIDED.replace(
        "least(0.9e0, greatest(0.1e0, 0.446454e0 * (1e0 - risk_term))) AS thr_attack",
        "0.446454e0 AS thr_attack",
    ),
    "decided",
)


def _persistence(policy: SplitPolicy):
    def build(df: DataFrame) -> DataFrame:
        g = decisions.device_series(df, policy=policy)
        g = g.add(_raw=decisions.raw_flag("score_geo", 0.5))
        return g.add(
            raw="_raw",
            **{f"held_{n}": decisions.persistent(g, "_raw", n) for n in (1, 2, 4)},
        ).finish()

    return _on_scored(build)


_register(
    "persistence",
    _persistence(SplitPolicy()),
    KEYS | exact("raw", "held_1", "held_2", "held_4"),
    oracle.DECIDED,
    """(SELECT *, b_geo AS raw, b_geo AS held_1, CAST(run_geo >= 2 AS INTEGER) AS held_2,
          CAST(run_geo >= 4 AS INTEGER) AS held_4 FROM decided)""",
)
_register(
    "operational_decisions",
    _on_decided(lambda df: df),
    KEYS | exact("operational_label", "op_best_score"),
    oracle.DECIDED,
    "decided",
)

# -- device-day and device rollups --------------------------------------------------------------
DASHBOARD_SHAPE = (
    exact(S.DEVICE, "date", "has_cyber", "op_label_top", "max_op_score")
    | rounded(["risk_mean"])
    | exact("cvss", "epss", "dvd", "rec_action")
)
_register(
    "device_day_risk", _on_decided(rollups.risk_dashboard), DASHBOARD_SHAPE,
    oracle.DASHBOARD, "dashboard",
)
_register("dashboard_saved_as_csv", _dashboard_back, DASHBOARD_SHAPE, oracle.DASHBOARD, "dashboard")
_register(
    "dashboard_of_daily_runs",
    lambda spark, sf_dir: daily.dashboard(spark, _daily_runs(spark, sf_dir)),
    DASHBOARD_SHAPE,
    oracle.DASHBOARD,
    "dashboard",
)
_register(
    "modal_label_per_day",
    _on_decided(
        lambda df: rollups.most_frequent(
            df.withColumn("date", F.to_date(S.RECEIVED)),
            [S.DEVICE, "date"],
            "operational_label",
        )
    ),
    exact(S.DEVICE, "date", "operational_label"),
    oracle.DASHBOARD,
    """(SELECT "Device_ID", date, op_label_top AS operational_label FROM label_top)""",
)
_register(
    "dashboard_date_range",
    _on_dashboard(
        lambda df: rollups.filter_dashboard(df, ("2024-01-05", "2024-01-12"))
    ),
    DASHBOARD_SHAPE,
    oracle.DASHBOARD,
    "(SELECT * FROM dashboard WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12')",
)
_register(
    "dashboard_devices",
    _on_dashboard(lambda df: rollups.filter_dashboard(df, devices=["D002", "D007"])),
    DASHBOARD_SHAPE,
    oracle.DASHBOARD,
    """(SELECT * FROM dashboard WHERE "Device_ID" IN ('D002', 'D007'))""",
)
_register(
    "date_bounds",
    _on_dashboard(rollups.date_bounds),
    exact("first", "last"),
    oracle.DASHBOARD,
    "(SELECT min(date) AS first, max(date) AS last FROM dashboard)",
)
_register(
    "cyber_days",
    _on_dashboard(rollups.cyber_days),
    exact(S.DEVICE, "cyber_days"),
    oracle.DASHBOARD,
    """(SELECT "Device_ID", CAST(sum(has_cyber) AS BIGINT) AS cyber_days
        FROM dashboard GROUP BY "Device_ID")""",
)
_register(
    "anomaly_days",
    _on_decided(rollups.anomaly_days),
    exact(S.DEVICE, "date", "cyber_hits", "cyber_days", "op_anom", "n"),
    oracle.DAYS,
    "days",
)
_register(
    "anomaly_days_of_daily_runs",
    lambda spark, sf_dir: cells.anomaly_days_of(
        daily.read_cells(spark, _daily_runs(spark, sf_dir))
    ),
    exact(S.DEVICE, "date", "cyber_hits", "cyber_days", "op_anom", "n"),
    oracle.DAYS,
    "days",
)
_register(
    "anomaly_summary",
    _on_decided(lambda df: rollups.anomaly_summary(rollups.anomaly_days(df))),
    exact(S.DEVICE, "cyber_days", "cyber_total", "op_days", "samples"),
    oracle.DAYS,
    "summary",
)


def _posture_with_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posture of all customers' devices joined with the few that reported."""
    fleet = fixture.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("D"), F.lpad(F.col("c_custkey").cast("string"), 3, "0")).alias(S.DEVICE),
        F.col("c_acctbal").alias("cvss"),
    )
    summary = rollups.anomaly_summary(rollups.anomaly_days(_decided(spark, sf_dir)))
    return rollups.join_summary(fleet, summary)


_register(
    "posture_with_summary",
    _posture_with_summary,
    exact(S.DEVICE, "cvss", "cyber_days", "cyber_total", "op_days", "samples"),
    oracle.DAYS,
    """(SELECT f."Device_ID", cvss, coalesce(cyber_days, 0) AS cyber_days,
          coalesce(cyber_total, 0) AS cyber_total, coalesce(op_days, 0) AS op_days,
          coalesce(samples, 0) AS samples
        FROM (SELECT 'D' || lpad(CAST(c_custkey AS VARCHAR), 3, '0') AS "Device_ID",
                c_acctbal AS cvss FROM customer) f
        LEFT JOIN summary s ON s."Device_ID" = f."Device_ID")""",
)
POSTURE_SHAPE = (
    exact(S.DEVICE, *S.POSTURE_MEASURES)
    | rounded([f"{c}_final" for c in S.POSTURE_MEASURES])
    | exact("cyber_days", "cyber_total", "op_days", "samples")
)
DELTA_SHAPE = {c: p for c, p in POSTURE_SHAPE.items() if c != "cyber_total"} | rounded(
    [f"delta_{c}" for c in S.POSTURE_MEASURES]
)
_register("posture_update", _on_posture(lambda df: df), POSTURE_SHAPE, oracle.DAYS, "updated")
_register("posture_saved", _posture_back, POSTURE_SHAPE, oracle.DAYS, "updated")
_register(
    "posture_deltas",
    _on_posture(lambda df: rollups.by_increase(rollups.posture_deltas(df))),
    DELTA_SHAPE,
    oracle.DAYS,
    "deltas",
)
for _measure in S.POSTURE_MEASURES:
    _register(
        f"top_{_measure}_increases",
        _on_posture(
            lambda df, m=_measure: rollups.largest_increases(
                rollups.posture_deltas(df), m, 5
            )
        ),
        DELTA_SHAPE,
        oracle.DAYS,
        f'(SELECT * FROM deltas ORDER BY delta_{_measure} DESC, "Device_ID" LIMIT 5)',
    )
FOUND_SHAPE = (
    exact(S.DEVICE)
    | rounded(["cvss_mean"])
    | exact("cvss_max")
    | rounded(["epss_comb"], SINGLE)
    | exact("dvd")
)
_register(
    "posture_sample",
    lambda spark, sf_dir: rollups.posture_from_findings(fixture.findings(spark, sf_dir))
    .orderBy(S.DEVICE)
    .limit(10),
    FOUND_SHAPE,
    oracle.FINDINGS,
    '(SELECT * FROM found ORDER BY "Device_ID" LIMIT 10)',
)
_register(
    "posture_from_findings",
    lambda spark, sf_dir: rollups.posture_from_findings(fixture.findings(spark, sf_dir)),
    FOUND_SHAPE,
    oracle.FINDINGS,
    "found",
)
_register(
    "posture_from_telemetry",
    _on_telemetry(rollups.posture_from_telemetry),
    exact(S.DEVICE) | rounded(["cvss_mean", "epss_comb", "dvd"]) | exact("cvss_max"),
    oracle.TELEMETRY,
    """(SELECT "Device_ID", avg(cvss) AS cvss_mean, avg(epss) AS epss_comb, avg(dvd) AS dvd,
          max(cvss) AS cvss_max FROM scored GROUP BY "Device_ID")""",
)


def _posture_used(**options):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        # written once: its size is counted before it is joined
        posture = materialise(
            rollups.posture_from_findings(fixture.findings(spark, sf_dir))
        )
        telemetry = fixture.finding_telemetry(spark, sf_dir)
        return replace_posture(telemetry, posture, **options)

    return build


_USED_SHAPE = (
    exact(S.DEVICE, S.ROW_ID)
    | rounded(["cvss_used", "dvd_used"])
    | rounded(["epss_used"], SINGLE)
)


def _used_sql(cvss: str) -> str:
    return f"""(SELECT CAST(o_orderkey AS VARCHAR) AS "Device_ID", o_orderkey AS event_id,
          coalesce({cvss}, 0e0) AS cvss_used, coalesce(epss_comb, 0e0) AS epss_used,
          coalesce(dvd, 0) AS dvd_used
        FROM orders LEFT JOIN found ON found."Device_ID" = CAST(o_orderkey AS VARCHAR))"""


_register(
    "telemetry_with_posture", _posture_used(), _USED_SHAPE, oracle.FINDINGS, _used_sql("cvss_max")
)
_register(
    "telemetry_with_mean_posture",
    _posture_used(cvss_column="cvss_mean"),
    _USED_SHAPE,
    oracle.FINDINGS,
    _used_sql("cvss_mean"),
)


def _heavy_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join's plan for device tables too large to broadcast, with devices
    heavy enough to be treated apart."""
    devices = rollups.posture_from_telemetry(fixture.telemetry(spark, sf_dir))
    facts = fixture.telemetry(spark, sf_dir).drop(*S.POSTURE_MEASURES)
    return attach_per_device(
        facts, devices, S.DEVICE, broadcast_rows=1, policy=MANY_PIECES
    )


_register(
    "telemetry_with_large_posture",
    _heavy_devices,
    KEYS | rounded(["cvss_mean", "epss_comb"]) | exact("cvss_max"),
    oracle.TELEMETRY,
    """(SELECT *, avg(cvss) OVER d AS cvss_mean, avg(epss) OVER d AS epss_comb,
          max(cvss) OVER d AS cvss_max FROM scored WINDOW d AS (PARTITION BY "Device_ID"))""",
)
_register(
    "overview",
    _on_decided(rollups.overview),
    exact("devices", "rows") | rounded(["cyber_prevalence"]) | exact("cyber_alerts"),
    oracle.DECIDED,
    """(SELECT count(DISTINCT "Device_ID") AS devices, count(*) AS rows,
          avg(is_cyber_true) AS cyber_prevalence,
          CAST(sum(pred_attack_bin) AS BIGINT) AS cyber_alerts FROM decided)""",
)
_register(
    "overview_of_range",
    lambda spark, sf_dir: daily.overview(
        spark, _daily_runs(spark, sf_dir), ("2024-01-05", "2024-01-12")
    ),
    exact("devices", "rows") | rounded(["cyber_prevalence"]) | exact("cyber_alerts"),
    oracle.DECIDED,
    """(SELECT count(DISTINCT "Device_ID") AS devices, count(*) AS rows,
          avg(is_cyber_true) AS cyber_prevalence,
          CAST(sum(pred_attack_bin) AS BIGINT) AS cyber_alerts FROM decided
        WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12')""",
)


def _devices_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per day, united per year; every order is a device of its own, so
    the estimate is held against the number of rows."""
    reports = fixture.finding_telemetry(spark, sf_dir).select(
        S.DEVICE,
        F.to_date(S.RECEIVED).alias("date"),
        F.lit(1).cast("long").alias("n"),
        *[F.lit(0).cast("long").alias(c) for c in ("attacks", "alerts")],
    )
    totals = materialise(cells.day_totals(reports))
    found = cells.overview_of(totals, F.year("date").alias("year"))
    return found.withColumn(
        "within_3_percent", F.abs(F.col("devices") - F.col("rows")) <= 0.03 * F.col("rows")
    )


_register(
    "devices_per_year",
    _devices_per_year,
    exact("year", "rows", "within_3_percent"),
    """
years AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS "rows", true AS within_3_percent
  FROM orders GROUP BY 1
)""",
    "years",
)
_register(
    "device_ids",
    _on_telemetry(rollups.device_ids),
    exact(S.DEVICE),
    oracle.TELEMETRY,
    '(SELECT DISTINCT "Device_ID" FROM scored ORDER BY 1)',
)
_register(
    "device_counts",
    _on_decided(rollups.device_counts),
    exact(S.DEVICE, "pred_cyber_flags", "true_cyber", "records"),
    oracle.DECIDED,
    """(SELECT "Device_ID", CAST(sum(pred_attack_bin) AS BIGINT) AS pred_cyber_flags,
          CAST(sum(is_cyber_true) AS BIGINT) AS true_cyber, count(*) AS records
        FROM decided GROUP BY "Device_ID")""",
)
_register(
    "top_labels",
    _on_decided(rollups.top_labels),
    exact(S.DEVICE, "operational_label", "count", "place"),
    oracle.DECIDED,
    """(SELECT "Device_ID", operational_label, count(*) AS count,
          CAST(row_number() OVER (PARTITION BY "Device_ID"
            ORDER BY count(*) DESC, operational_label) AS INTEGER) AS place
        FROM decided GROUP BY "Device_ID", operational_label QUALIFY place <= 3)""",
)
# more labels than the sketches track, so that some devices need the full count
_OPEN_LABEL = "concat_ws('/', operational_label, CAST(floor(score_geo * 50) AS STRING))"
_register(
    "frequent_labels",
    _on_decided(
        lambda df: sketched.frequent_labels(
            materialise(df.withColumn("operational_label", F.expr(_OPEN_LABEL))), tracked=64
        )
    ),
    exact(S.DEVICE, "operational_label", "count", "place"),
    oracle.DECIDED,
    """(SELECT "Device_ID", operational_label || '/' || CAST(floor(score_geo * 50) AS BIGINT) AS operational_label,
          count(*) AS count, CAST(row_number() OVER (PARTITION BY "Device_ID"
            ORDER BY count(*) DESC, operational_label || '/' || CAST(floor(score_geo * 50) AS BIGINT)) AS INTEGER) AS place
        FROM decided GROUP BY 1, 2 QUALIFY place <= 3)""",
)
_HOURLY_SQL = (
    oracle.DECIDED
    + """,
hourly AS (
  SELECT date_trunc('hour', "timestamp") AS hour,
    count(*) FILTER (operational_label = 'normal') AS "normal",
    count(*) FILTER (operational_label = 'Loss_of_storage_condition')
      AS "Loss_of_storage_condition",
    count(*) FILTER (operational_label = 'Geofence_anomaly') AS "Geofence_anomaly",
    count(*) FILTER (operational_label = 'Tamper_Damage_anomaly') AS "Tamper_Damage_anomaly",
    count(*) FILTER (operational_label IS NULL OR operational_label NOT IN ('normal',
      'Loss_of_storage_condition', 'Geofence_anomaly', 'Tamper_Damage_anomaly')) AS other
  FROM decided GROUP BY 1
)"""
)
_register(
    "hourly_labels",
    _on_decided(rollups.hourly_labels),
    exact("hour", S.NORMAL, *S.OPERATIONAL_LABELS, "other"),
    _HOURLY_SQL,
    "hourly",
)
_register(
    "hourly_labels_of_device",
    _on_decided(lambda df: rollups.hourly_labels(df, device="D001")),
    exact("hour", S.NORMAL, *S.OPERATIONAL_LABELS, "other"),
    _HOURLY_SQL.replace("FROM decided GROUP", "FROM decided WHERE \"Device_ID\" = 'D001' GROUP"),
    "hourly",
)
_register(
    "hourly_labels_long",
    _on_decided(lambda df: rollups.long_labels(rollups.hourly_labels(df))),
    exact("hour", "operational_label", "count"),
    _HOURLY_SQL,
    "(UNPIVOT hourly ON COLUMNS(* EXCLUDE (hour)) INTO NAME operational_label VALUE count)",
)
_FALSE_SQL = (
    oracle.DECIDED
    + """,
daily AS (
  SELECT "Device_ID", date, sum(CAST(pred_attack_bin = 1
      AND primary_label_reported = 'normal' AS INTEGER)) AS fp
  FROM decided GROUP BY "Device_ID", date
)"""
)
_register(
    "false_alarm_rate",
    _on_decided(lambda df: rollups.false_alarm_rate(df, "pred_attack_bin")),
    rounded(["avg_fp_per_device_day"]),
    _FALSE_SQL,
    "(SELECT avg(fp) AS avg_fp_per_device_day FROM daily)",
)
_register(
    "false_alarms_per_device",
    _on_decided(lambda df: rollups.false_alarms_per_device(df, "pred_attack_bin")),
    exact(S.DEVICE) | rounded(["avg_fp_per_day"]),
    _FALSE_SQL,
    '(SELECT "Device_ID", avg(fp) AS avg_fp_per_day FROM daily GROUP BY "Device_ID")',
)

# -- time bins ---------------------------------------------------------------------------------
BIN_SHAPE = (
    exact(S.DEVICE, "timestamp")
    | rounded(["score_attack_sup"])
    | exact("pred_attack_bin", "is_cyber_true")
)
_BINS_SQL = (
    oracle.DECIDED
    + """,
bins AS (
  SELECT "Device_ID", time_bucket(INTERVAL '5 minutes', "timestamp") AS bin,
    avg(score_attack_sup) AS score_attack_sup, max(pred_attack_bin) AS pred_attack_bin,
    max(is_cyber_true) AS is_cyber_true
  FROM decided GROUP BY "Device_ID", bin
),
spine AS (
  SELECT "Device_ID", unnest(generate_series(min(bin), max(bin), INTERVAL '5 minutes')) AS bin
  FROM bins GROUP BY "Device_ID"
)"""
)
_register(
    "time_bins",
    _on_decided(rollups.time_bins),
    BIN_SHAPE,
    _BINS_SQL,
    '(SELECT *, bin AS "timestamp" FROM bins)',
)
_register(
    "filled_time_bins",
    _on_decided(lambda df: rollups.fill_bins(rollups.time_bins(df))),
    BIN_SHAPE,
    _BINS_SQL,
    """(SELECT "Device_ID", bin AS "timestamp", score_attack_sup, pred_attack_bin, is_cyber_true
        FROM spine LEFT JOIN bins USING ("Device_ID", bin))""",
)

# -- evaluation ----------------------------------------------------------------------------------
SCORES = {
    "temp": ("score_temp", "y_temp"),
    "geo": ("score_geo", "y_geo"),
    "tamper": ("score_tamper", "y_tamper"),
    "attack": ("score_attack_sup", "y_attack"),
}
BETAS = asdict(SweepBetas())


def _on_points(step: Callable[[DataFrame], DataFrame], policy: SplitPolicy = SplitPolicy()):
    return _on_scored(
        lambda df: step(
            evaluate.score_points(
                evaluate.stack_detectors(split.add_targets(df), SCORES), policy=policy
            )
        )
    )


_CURVE = exact("detector", "threshold")
_PR_SQL = """(SELECT detector, score AS threshold, precision, recall FROM rates
  UNION ALL SELECT DISTINCT detector, CAST(NULL AS DOUBLE), 1e0, 0e0 FROM rates)"""
_ROC_SQL = """(SELECT detector, score AS threshold, fpr, recall AS tpr FROM rates
    WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
  UNION ALL SELECT DISTINCT detector, CAST('inf' AS DOUBLE), 0e0, 0e0 FROM rates)"""
_AREA_SQL = """(SELECT detector, sum((recall - recall0) * (precision + precision0) / 2e0) AS pr_auc,
    sum((fpr - fpr0) * (recall + recall0) / 2e0) AS roc_auc FROM traced GROUP BY detector)"""
for _name, _policy in (("", SplitPolicy()), ("_many_scores", MANY_PIECES)):
    _register(
        f"pr_curve{_name}",
        _on_points(evaluate.pr_curve, _policy),
        _CURVE | rounded(["precision", "recall"]),
        oracle.POINTS,
        _PR_SQL,
    )
    _register(
        f"roc_curve{_name}",
        _on_points(evaluate.roc_curve, _policy),
        _CURVE | rounded(["fpr", "tpr"]),
        oracle.POINTS,
        _ROC_SQL,
    )
    _register(
        f"curve_areas{_name}",
        _on_points(evaluate.areas, _policy),
        exact("detector") | rounded(["pr_auc", "roc_auc"]),
        oracle.POINTS,
        _AREA_SQL,
    )


def _sketched_areas(df: DataFrame) -> DataFrame:
    """Areas from sketches of days, merged, beside the exact ones."""
    scored = evaluate.stack_detectors(split.add_targets(df), SCORES)
    stacked = materialise(scored)
    halves = [stacked.where(F.pmod(F.xxhash64("score"), F.lit(2)) == n) for n in (0, 1)]
    parts = sketched.score_sketches(halves[0]).unionByName(sketched.score_sketches(halves[1]))
    points = materialise(sketched.sketched_points(sketched.merge_sketches(parts)))
    near = evaluate.areas(points).select("detector", F.col("pr_auc").alias("pr"), F.col("roc_auc").alias("roc"))
    exact_areas = evaluate.areas(evaluate.score_points(stacked))
    return (
        exact_areas.join(near, "detector")
        .join(sketched.area_bounds(points), "detector")
        .select(
            "detector",
            (F.abs(F.col("pr") - F.col("pr_auc")) <= 0.02).alias("pr_near"),
            (F.abs(F.col("roc") - F.col("roc_auc")) <= 0.01).alias("roc_near"),
            F.col("pr_auc").between(F.col("pr_low"), F.col("pr_high")).alias("pr_bounded"),
            F.col("roc_auc").between(F.col("roc_low"), F.col("roc_high")).alias("roc_bounded"),
        )
    )


_register(
    "sketched_areas",
    _on_scored(_sketched_areas),
    exact("detector", "pr_near", "roc_near", "pr_bounded", "roc_bounded"),
    oracle.POINTS,
    """(SELECT DISTINCT detector, true AS pr_near, true AS roc_near, true AS pr_bounded,
          true AS roc_bounded FROM rates)""",
)
_register(
    "best_thresholds",
    _on_points(lambda p: evaluate.best_thresholds(p, BETAS)),
    exact("detector", "threshold") | rounded(["f"]),
    oracle.POINTS
    + """,
weighed AS (
  SELECT *, CASE detector WHEN 'tamper' THEN 4e0 WHEN 'attack' THEN 1e0 ELSE pow(1.3e0, 2e0) END
    AS b FROM rates
),
swept AS (
  SELECT *, (1e0 + b) * (precision * recall) / greatest(b * precision + recall, 1e-9) AS f
  FROM weighed
)""",
    """(SELECT detector, score AS threshold, f FROM swept
        QUALIFY row_number() OVER (PARTITION BY detector ORDER BY f DESC, score) = 1)""",
)
_register(
    "confusion_matrix",
    _on_decided(
        lambda df: evaluate.confusion_matrix(
            df.withColumn("_t", F.expr(X.is_label(S.LABEL, S.CYBER))), "_t", "pred_attack_bin"
        )
    ),
    exact("truth", "prediction", "count") | rounded(["row_percent"]),
    oracle.DECIDED,
    """(SELECT truth, prediction, count(event_id) AS count,
          coalesce(100e0 * count(event_id)
            / nullif(sum(count(event_id)) OVER (PARTITION BY truth), 0), 0e0) AS row_percent
        FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) cells(truth, prediction)
        LEFT JOIN decided ON is_cyber_true = truth AND pred_attack_bin = prediction
        GROUP BY truth, prediction)""",
)
REPORT_SHAPE = exact("label") | rounded(["precision", "recall", "f1"], 3) | exact("support")
_register(
    "operational_report",
    _on_decided(evaluate.operational_report),
    REPORT_SHAPE,
    oracle.report(
        "CASE WHEN primary_label_reported = 'Cyberattack_anomaly' THEN 'normal'"
        " ELSE primary_label_reported END",
        "operational_label",
    ),
    "report",
)
_register(
    "cyber_report",
    _on_decided(evaluate.cyber_report),
    REPORT_SHAPE,
    oracle.report("CAST(is_cyber_true AS VARCHAR)", "CAST(pred_attack_bin AS VARCHAR)"),
    "report",
)
_register(
    "prevalence",
    _on_telemetry(lambda df: evaluate.prevalence(df, F.expr(X.is_anomaly(S.LABEL)))),
    rounded(["prevalence"]),
    oracle.TELEMETRY,
    """(SELECT avg(CAST(primary_label_reported <> 'normal' AS INTEGER)) AS prevalence
        FROM scored)""",
)

# -- learning -------------------------------------------------------------------------------------
_register(
    "standardised",
    _on_telemetry(lambda df: Scaling.fit(df, S.TELEMETRY_FEATURES).apply(df)),
    KEYS | rounded([f"z_{f}" for f in S.TELEMETRY_FEATURES]),
    oracle.TELEMETRY,
    "(SELECT *, "
    + ", ".join(
        f"(coalesce({f}, 0e0) - avg(coalesce({f}, 0e0)) OVER ())"
        f" / coalesce(nullif(stddev_pop(coalesce({f}, 0e0)) OVER (), 0e0), 1e0) AS z_{f}"
        for f in S.TELEMETRY_FEATURES
    )
    + " FROM scored)",
)


def _folds(df: DataFrame) -> DataFrame:
    """Class sizes per fold: they differ by one at most."""
    folded = stratified_folds(split.add_targets(df), "y_attack", 3, policy=MANY_PIECES)
    return folded.groupBy("y_attack").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("fold").alias("folds"),
        *[F.count_if(F.col("fold") == n).alias(f"fold_{n}") for n in range(3)],
    )


_register(
    "stratified_folds",
    _on_telemetry(_folds),
    exact("y_attack", "rows", "folds", "fold_0", "fold_1", "fold_2"),
    oracle.TELEMETRY
    + """,
placed AS (
  SELECT CAST(primary_label_reported = 'Cyberattack_anomaly' AS INTEGER) AS y_attack,
    row_number() OVER (PARTITION BY primary_label_reported = 'Cyberattack_anomaly') - 1 AS p,
    count(*) OVER (PARTITION BY primary_label_reported = 'Cyberattack_anomaly') AS n
  FROM scored
)""",
    """(SELECT y_attack, count(*) AS rows, count(DISTINCT 3 * p // n) AS folds,
          count(*) FILTER (3 * p // n = 0) AS fold_0, count(*) FILTER (3 * p // n = 1) AS fold_1,
          count(*) FILTER (3 * p // n = 2) AS fold_2 FROM placed GROUP BY y_attack)""",
)


def _training_rows(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """The whole table with its targets, its side, and the columns that the
    models read."""
    marked = split.add_validation(features.lay_out_reports(df))
    featured = split.add_targets(features.add_features(marked, features.has_gps(df))[0].finish())
    keys = (S.DEVICE, S.RECEIVED, S.ROW_ID, S.LABEL, "is_augmented", split.VALIDATION)
    more = sorted({*inputs} - {*keys})
    return materialise(featured.select(*keys, *split.TARGETS, *more))


def _trees(rounds: int) -> dict:
    return {"rounds": F.lit(rounds), "depth": F.lit(SHORT_BOOST.max_depth)}


def _operational_scores(df: DataFrame) -> DataFrame:
    """Trained on one side, scored on the whole table; `rounds` and `depth` say
    how many trees a fold has and how deep they are."""
    rows = _training_rows(df, [c for names, _ in OPERATIONAL.values() for c in names])
    train, _ = split.train_and_validation(rows)
    scored = rows.withColumns(_trees(SHORT_BOOST.operational_iterations))
    for name, (inputs, target) in OPERATIONAL.items():
        scored = fit_operational(train, inputs, target, SHORT_BOOST).score(scored, f"score_{name}")
    return scored


def _attack_scores(df: DataFrame) -> DataFrame:
    rows = _training_rows(df, S.ATTACK_FEATURES)
    train, held_out = split.train_and_validation(rows)
    model = fit_attack(train, split.without_augmented(held_out), SHORT_BOOST)
    scored = rows.withColumns(_trees(SHORT_BOOST.attack_iterations))
    return model.score(scored, "score_attack_sup")


def _saved_detectors(df: DataFrame) -> DataFrame:
    """All four detectors trained, saved, loaded, and both held side by side on
    every row; with the area under the curve of the held-out side."""
    spark = df.sparkSession
    inputs = [*S.ATTACK_FEATURES, *[c for names, _ in OPERATIONAL.values() for c in names]]
    rows = _training_rows(df, inputs)
    train, held_out = split.train_and_validation(rows)
    fitted = fit_detectors(train, split.without_augmented(held_out), SHORT_BOOST)
    path = new_path(spark, "detectors")
    version = save_detectors(spark, fitted, path, CONFIG.persistence)
    loaded = load_detectors(spark, path, version)
    keys = (S.ROW_ID, split.VALIDATION, *split.TARGETS)
    names = ("temp", "geo", "tamper", "attack_sup")
    fresh = fitted.score(rows).withColumns({f"own_{n}": F.col(f"score_{n}") for n in names})
    both = materialise(loaded.detectors.score(fresh).select(*keys, *[f"{k}_{n}" for k in ("own", "score") for n in names]))
    targets = {n: "y_attack" if n == "attack_sup" else f"y_{n}" for n in names}
    sides = {n: (f"score_{n}", target) for n, target in targets.items()}
    areas = evaluate.areas(evaluate.score_points(evaluate.stack_detectors(both.where(F.col(split.VALIDATION) == 1), sides)))
    stacked = both.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("detector"), F.col(f"own_{n}").alias("own"), F.col(f"score_{n}").alias("score"))
                    for n in names
                ]
            )
        ).alias("s")
    ).select("s.*")
    found = stacked.groupBy("detector").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("own").eqNullSafe(F.col("score"))).alias("unequal"),
        F.bool_and(F.col("score").between(0.0, 1.0)).alias("in_bounds"),
    )
    same_cuts = loaded.detectors.thresholds == fitted.thresholds and loaded.persistence == CONFIG.persistence
    return found.join(areas, "detector").select(
        "detector", "rows", "unequal", "in_bounds", F.lit(same_cuts).alias("same_cuts"), (F.col("roc_auc") > 0.5).alias("better_than_chance")
    )


def _run_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From CSV files to saved results: train and save detectors, then score two
    halves of the time in two runs into one output. What is compared does not
    depend on how many trees there are, so there is one for each."""
    path = new_path(spark, "run")
    reports = materialise(fixture.telemetry(spark, sf_dir))
    as_text = {c: F.col(c).cast("string") for c in (S.RECEIVED, S.REPORTED)}
    rows = reports.withColumns(as_text)
    first = F.day(F.col(S.RECEIVED).cast("timestamp_ntz")) <= 15
    files = {"all": rows, "early": rows.where(first), "late": rows.where(~first)}
    for name, part in files.items():
        part.write.csv(f"{path}/{name}", header=True)
    posture = [f.name for f in results.POSTURE_SCHEMA.fields[:-1]]
    held = fixture.posture(spark, sf_dir).select(*posture, F.lit(0).alias("nist_gap_count"))
    held.write.csv(f"{path}/posture", header=True)
    runs.train_and_save(spark, f"{path}/all", f"{path}/models", policy=ONE_TREE)
    for name in ("early", "late"):
        runs.alert_with_saved(spark, f"{path}/{name}", f"{path}/posture", f"{path}/models", f"{path}/out")
    saved = results.read_results(spark, f"{path}/out")
    counted = saved[results.PREDICTIONS].groupBy(S.DEVICE, "date").agg(F.count(F.lit(1)).alias("rows"))
    known = F.col("has_cyber").isin(0, 1) & F.col("max_op_score").between(0.0, 1.0)
    days = saved[results.DASHBOARD].withColumn("in_bounds", known)
    return days.join(counted, [S.DEVICE, "date"])


def _isolation_forest(df: DataFrame) -> DataFrame:
    return fit_forest(df).predict(df)


def _risk_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    telemetry = fixture.telemetry(spark, sf_dir)
    posture = materialise(rollups.posture_from_telemetry(telemetry))
    rows = replace_posture(telemetry, posture)
    return fit_fusion(rows).score(rows)


_register(
    "operational_scores",
    _on_telemetry(_operational_scores),
    KEYS | exact("rounds", "depth") | rounded([f"score_{name}" for name in OPERATIONAL]),
)
_register(
    "attack_scores",
    _on_telemetry(_attack_scores),
    KEYS | exact("rounds", "depth") | rounded(["score_attack_sup"]),
)
_register(
    "saved_detectors",
    _on_telemetry(_saved_detectors),
    exact("detector", "rows", "unequal", "in_bounds", "same_cuts", "better_than_chance"),
    """
held AS (
  SELECT unnest(['temp', 'geo', 'tamper', 'attack_sup']) AS detector, count(*) AS "rows",
    CAST(0 AS BIGINT) AS unequal, true AS in_bounds, true AS same_cuts, true AS better_than_chance
  FROM events
)""",
    "held",
)


def _baselines(df: DataFrame) -> DataFrame:
    """Both baselines fitted on the earlier rows of every device and judged on
    the later ones: support per class, and whether scores and flags are usable."""
    train, test = split.train_and_validation(materialise(split.mark_validation(df)))
    outputs = materialise(runs.run_baselines(train, test))
    truth = F.expr(X.is_anomaly(S.LABEL)).cast("string")
    reports = []
    for name, score, flag in (("isolation", "IF_score", "IF_pred"), ("fusion", "RF_prob", "RF_pred")):
        report = evaluate.classification_report(outputs, truth, F.col(flag).cast("string"))
        low, high, share = outputs.agg(F.min(score), F.max(score), F.avg(flag)).first()
        usable = F.lit(0.0 <= low < high <= 1.0 and 0.0 <= share < 1.0)
        reports.append(report.select(F.lit(name).alias("baseline"), "label", "support", usable.alias("usable")))
    return reports[0].unionByName(reports[1])


_register(
    "run_from_files",
    _run_from_files,
    exact(S.DEVICE, "date", "rows", "cvss", "epss", "dvd") | rounded(["risk_mean"]) | exact("in_bounds"),
    oracle.DASHBOARD,
    """(SELECT "Device_ID", date, count(*) AS "rows", max(cvss) AS cvss, max(epss) AS epss,
          max(dvd) AS dvd, avg(risk_score_combined) AS risk_mean, true AS in_bounds
        FROM decided GROUP BY 1, 2)""",
)
_register(
    "baselines",
    _on_telemetry(_baselines),
    exact("baseline", "label", "support", "usable"),
    oracle.TELEMETRY
    + """,
later AS (
  SELECT CAST(primary_label_reported <> 'normal' AS INTEGER) AS t FROM scored
  QUALIFY row_number() OVER (PARTITION BY "Device_ID" ORDER BY "timestamp", event_id)
    > greatest(floor(0.8e0 * count(*) OVER (PARTITION BY "Device_ID")), 1)
),
supports AS (
  SELECT CAST(t AS VARCHAR) AS label, count(*) AS support FROM later GROUP BY t
  UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), count(*) FROM later
),
rows_of AS (
  SELECT unnest(['isolation', 'fusion']) AS baseline, label, support, true AS usable FROM supports
)""",
    "rows_of",
)
_register(
    "isolation_forest",
    _on_telemetry(_isolation_forest),
    KEYS | rounded(["IF_score"]) | exact("IF_pred"),
)
_register("risk_fusion", _risk_fusion, KEYS | rounded(["RF_prob"]) | exact("RF_pred"))
