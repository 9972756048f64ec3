"""The registered queries again, as plain SQL over the given tables.

Written for an independent engine: other window formulations, a recursive
query for the smoothed mean, islands for run lengths.
"""

from __future__ import annotations

# -- building blocks ------------------------------------------------------------
TELEMETRY = """
raw AS (
  SELECT *, CAST(props->>'$.k' AS INTEGER) AS k, CAST(user_id % 10 AS INTEGER) AS d
  FROM events
),
scored AS (
  SELECT
    'D' || lpad(CAST(d + 1 AS VARCHAR), 3, '0') AS "Device_ID",
    ts AS "timestamp",
    CASE WHEN k <> 99 THEN ts - to_minutes((k % 20) * 3) END AS timestamp_reported,
    CASE WHEN k <> 98 THEN 2e0 + floor(value / 25e0) * 0.5e0 END AS temp_reported,
    40e0 + floor(k / 50) * 5e0 AS humidity_reported,
    value * 10e0 AS distance_from_route_reported,
    40e0 + d / 100e0 + floor(k / 50) * 0.5e0 AS lat_reported,
    -70e0 - d / 100e0 - floor(k / 50) * 0.5e0 AS lon_reported,
    CAST(event_type = 'signup' AND k % 10 = 0 AS INTEGER) AS tamper_reported,
    CAST(event_id % 7 = 0 AS INTEGER) AS is_augmented,
    CASE
      WHEN event_type = 'error' THEN 'Cyberattack_anomaly'
      WHEN event_type = 'purchase' AND value >= 100 THEN 'Loss_of_storage_condition'
      WHEN event_type = 'signup' AND k % 10 = 0 THEN 'Tamper_Damage_anomaly'
      WHEN event_type = 'signup' AND k % 10 = 1 THEN 'Geofence_anomaly'
      ELSE 'normal'
    END AS primary_label_reported,
    d * 1.1e0 AS cvss,
    ((d * 37) % 100) / 100e0 AS epss,
    CAST(d % 7 AS DOUBLE) AS dvd,
    event_id,
    round(least(1e0, value / 150e0), 4) AS score_temp,
    round(least(1e0, (k + value / 10e0) / 110e0), 4) AS score_geo,
    round(least(1e0, k / 99e0), 4) AS score_tamper,
    round(least(1e0, (k + CASE WHEN event_type = 'error' THEN 40e0 ELSE 0e0 END) / 139e0), 4)
      AS score_attack_sup
  FROM raw
)"""

THRESHOLDS = """
risk AS (
  SELECT *,
    least(0.7e0, greatest(0e0,
      0.15e0 * coalesce(epss, 0) + 0.35e0 * (coalesce(cvss, 0) / 10e0) + 0.05e0 * coalesce(dvd, 0)
    )) AS risk_term
  FROM scored
),
cuts AS (
  SELECT *,
    least(0.9e0, greatest(0.1e0, 0.446454e0 * (1e0 - risk_term))) AS thr_attack,
    (coalesce(epss >= 0.6e0, false) OR coalesce(cvss >= 8e0, false)) AS high_risk
  FROM risk
)"""

DECIDED = (
    TELEMETRY
    + ","
    + THRESHOLDS
    + """,
flags AS (
  SELECT *,
    CAST(score_temp >= 0.3483e0 AS INTEGER) AS b_temp,
    CAST(score_geo >= 0.5e0 AS INTEGER) AS b_geo,
    CAST(score_tamper >= 1e0 AS INTEGER) AS b_tamper,
    CAST(score_attack_sup >= thr_attack AS INTEGER) AS b_attack
  FROM cuts
),
islands AS (
  SELECT *,
    sum(1 - b_temp) OVER w AS i_temp,
    sum(1 - b_geo) OVER w AS i_geo,
    sum(1 - b_attack) OVER w AS i_attack
  FROM flags
  WINDOW w AS (PARTITION BY "Device_ID" ORDER BY "timestamp", event_id
               ROWS UNBOUNDED PRECEDING)
),
runs AS (
  SELECT *,
    sum(b_temp) OVER (PARTITION BY "Device_ID", i_temp ORDER BY "timestamp", event_id
                      ROWS UNBOUNDED PRECEDING) AS run_temp,
    sum(b_geo) OVER (PARTITION BY "Device_ID", i_geo ORDER BY "timestamp", event_id
                     ROWS UNBOUNDED PRECEDING) AS run_geo,
    sum(b_attack) OVER (PARTITION BY "Device_ID", i_attack ORDER BY "timestamp", event_id
                        ROWS UNBOUNDED PRECEDING) AS run_attack
  FROM islands
),
alerts AS (
  SELECT *,
    CAST(run_temp >= 4 AS INTEGER) AS pred_temp_bin,
    CAST(run_geo >= 4 AS INTEGER) AS pred_geo_bin,
    CAST(b_tamper = 1 OR tamper_reported > 0 AS INTEGER) AS pred_tamper_bin,
    CASE WHEN high_risk THEN b_attack ELSE CAST(run_attack >= 2 AS INTEGER) END
      AS pred_attack_bin
  FROM runs
),
labelled AS (
  SELECT *,
    CASE
      WHEN pred_temp_bin = 1
        AND (pred_geo_bin = 0 OR score_temp >= score_geo)
        AND (pred_tamper_bin = 0 OR score_temp >= score_tamper)
        THEN 'Loss_of_storage_condition'
      WHEN pred_geo_bin = 1 AND (pred_tamper_bin = 0 OR score_geo >= score_tamper)
        THEN 'Geofence_anomaly'
      WHEN pred_tamper_bin = 1 THEN 'Tamper_Damage_anomaly'
      ELSE 'normal'
    END AS operational_label,
    CASE WHEN pred_temp_bin + pred_geo_bin + pred_tamper_bin = 0 THEN 0e0
      ELSE greatest(
        CASE WHEN pred_temp_bin = 1 THEN score_temp END,
        CASE WHEN pred_geo_bin = 1 THEN score_geo END,
        CASE WHEN pred_tamper_bin = 1 THEN score_tamper END)
    END AS op_best_score
  FROM alerts
),
decided AS (
  SELECT *,
    CASE
      WHEN pred_attack_bin = 1 AND op_best_score < 0.5e0 THEN 'ISOLATE_DEVICE'
      WHEN operational_label = 'Loss_of_storage_condition' THEN 'PRIORITY_RECOVERY'
      WHEN operational_label <> 'normal' AND cvss >= 7e0 THEN 'PATCH_AND_MONITOR'
      ELSE 'MONITOR'
    END AS recommended_action,
    0.5e0 * coalesce(epss, 0) + 0.3e0 * (coalesce(cvss, 0) / 10e0) + 0.2e0 * coalesce(dvd, 0)
      AS risk_score_combined,
    CAST("timestamp" AS DATE) AS date,
    CAST(primary_label_reported = 'Cyberattack_anomaly' AS INTEGER) AS is_cyber_true
  FROM labelled
)"""
)

DASHBOARD = (
    DECIDED
    + """,
label_counts AS (
  SELECT "Device_ID", date, operational_label, count(*) AS n,
    min("timestamp") AS t0, arg_min(event_id, ("timestamp", event_id)) AS e0
  FROM decided GROUP BY ALL
),
label_top AS (
  SELECT "Device_ID", date, operational_label AS op_label_top FROM label_counts
  QUALIFY row_number() OVER (PARTITION BY "Device_ID", date ORDER BY n DESC, t0, e0) = 1
),
action_counts AS (
  SELECT "Device_ID", date, recommended_action, count(*) AS n,
    min("timestamp") AS t0, arg_min(event_id, ("timestamp", event_id)) AS e0
  FROM decided GROUP BY ALL
),
action_top AS (
  SELECT "Device_ID", date, recommended_action AS rec_action FROM action_counts
  QUALIFY row_number() OVER (PARTITION BY "Device_ID", date ORDER BY n DESC, t0, e0) = 1
),
dashboard AS (
  SELECT "Device_ID", date, max(pred_attack_bin) AS has_cyber, op_label_top,
    max(op_best_score) AS max_op_score, avg(risk_score_combined) AS risk_mean,
    max(cvss) AS cvss, max(epss) AS epss, max(dvd) AS dvd, rec_action
  FROM decided JOIN label_top USING ("Device_ID", date) JOIN action_top USING ("Device_ID", date)
  GROUP BY "Device_ID", date, op_label_top, rec_action
)"""
)

DAYS = (
    DECIDED
    + """,
days AS (
  SELECT "Device_ID", date,
    CAST(sum(pred_attack_bin) AS BIGINT) AS cyber_hits,
    CAST(max(pred_attack_bin) > 0 AS INTEGER) AS cyber_days,
    CAST(bool_or(operational_label <> 'normal') AS INTEGER) AS op_anom,
    count(pred_attack_bin) AS n
  FROM decided GROUP BY "Device_ID", date
),
summary AS (
  SELECT "Device_ID", CAST(sum(cyber_days) AS BIGINT) AS cyber_days,
    CAST(sum(cyber_hits) AS BIGINT) AS cyber_total,
    CAST(sum(op_anom) AS BIGINT) AS op_days, CAST(sum(n) AS BIGINT) AS samples
  FROM days GROUP BY "Device_ID"
),
posture AS (
  SELECT "Device_ID", max(cvss) AS cvss, max(epss) AS epss, max(dvd) AS dvd
  FROM scored GROUP BY "Device_ID"
),
joined AS (
  SELECT "Device_ID", cvss, epss, dvd, coalesce(cyber_days, 0) AS cyber_days,
    coalesce(cyber_total, 0) AS cyber_total, coalesce(op_days, 0) AS op_days,
    coalesce(samples, 0) AS samples
  FROM posture LEFT JOIN summary USING ("Device_ID")
),
updated AS (
  SELECT "Device_ID", cvss, epss, dvd,
    least(10e0, greatest(0e0,
      cvss + CASE WHEN cvss < 7 AND cyber_days >= 3 THEN 0.5e0 ELSE 0e0 END)) AS cvss_final,
    least(1e0, greatest(0e0,
      epss + least(0.25e0, 0.02e0 * cyber_days + 0.0005e0 * cyber_total))) AS epss_final,
    least(10e0, greatest(0e0, dvd + least(0.5e0, 0.05e0 * op_days))) AS dvd_final,
    cyber_days, cyber_total, op_days, samples
  FROM joined
),
deltas AS (
  SELECT * EXCLUDE (cyber_total), cvss_final - cvss AS delta_cvss,
    epss_final - epss AS delta_epss, dvd_final - dvd AS delta_dvd
  FROM updated
)"""
)

FINDINGS = """
findings AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS "Device_ID", CAST(l_partkey AS VARCHAR) AS vuln_id,
    l_quantity / 5e0 AS cvss, l_discount AS epss
  FROM lineitem
),
found AS (
  SELECT "Device_ID", avg(cvss) AS cvss_mean, max(cvss) AS cvss_max,
    1e0 - product(1e0 - coalesce(epss, 0e0)) AS epss_comb,
    count(DISTINCT vuln_id) AS dvd
  FROM findings GROUP BY "Device_ID"
)"""

_W = 'PARTITION BY "Device_ID" ORDER BY "timestamp", event_id'


def _rows(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def timing(source: str = "scored") -> str:
    delay = '(epoch_us("timestamp") - epoch_us(timestamp_reported)) / 6e7'

    def cv(gap: str) -> str:
        return (
            f"coalesce(CASE WHEN count({gap}) OVER {_rows(5)} >= 3 THEN"
            f" (stddev_pop({gap}) OVER {_rows(5)} + 1e-6) / (avg({gap}) OVER {_rows(5)} + 1e-6)"
            " END, 0e0)"
        )

    return f"""
gaps AS (
  SELECT *, {delay} AS delay_min,
    (epoch_us(timestamp_reported) - lag(epoch_us(timestamp_reported)) OVER ({_W})) / 6e7
      AS rpt_gap_min,
    (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER ({_W})) / 6e7 AS rcv_gap_min,
    CAST(coalesce(timestamp_reported < lag(timestamp_reported) OVER ({_W}), false) AS INTEGER)
      AS rpt_ooo
  FROM {source}
),
delays AS (
  SELECT *, CAST(coalesce(delay_min >= 5, false) AS INTEGER) AS delay_big,
    coalesce(rpt_gap_min - rcv_gap_min, 0e0) AS gap_err_min,
    coalesce(rpt_gap_min, 0e0) AS reported_ts_diff_min,
    CASE WHEN count(delay_min) OVER {_rows(12)} >= 3
      THEN median(delay_min) OVER {_rows(12)} END AS delay_med_1h,
    CASE WHEN count(delay_min) OVER {_rows(12)} >= 3
      THEN stddev_samp(delay_min) OVER {_rows(12)} END AS delay_std_1h,
    {cv("rpt_gap_min")} AS rpt_gap_cv_5,
    {cv("rcv_gap_min")} AS rcv_gap_cv_5
  FROM gaps
),
timing AS (
  SELECT *, (delay_min - delay_med_1h) / (delay_std_1h + 1e-6) AS delay_z FROM delays
)"""


GPS = f"""
places AS (
  SELECT *, CAST(coalesce(
      round_even(lat_reported, 5) = lag(round_even(lat_reported, 5)) OVER ({_W})
      AND round_even(lon_reported, 5) = lag(round_even(lon_reported, 5)) OVER ({_W}),
      false) AS INTEGER) AS gps_same
  FROM scored
),
stays AS (
  SELECT *, sum(1 - gps_same) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS stay FROM places
),
gps AS (
  SELECT *, CAST(sum(gps_same) OVER (
      PARTITION BY "Device_ID", stay ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING
    ) AS INTEGER) AS gps_repeat_count
  FROM stays
)"""


def sensor() -> str:
    frames = []
    for m, c in (("temp", "temp_reported"), ("hum", "humidity_reported")):
        for n in (3, 5, 7):
            frames.append(f"avg({c}) OVER {_rows(n)} AS {m}_roll_mean_{n}")
            frames.append(
                f"coalesce(stddev_samp({c}) OVER {_rows(n)}, 0e0) AS {m}_roll_std_{n}"
            )
        frames.append(f"coalesce(var_samp({c}) OVER {_rows(5)}, 0e0) AS {m}_var_5")
        frames.append(
            f"CASE WHEN count(*) OVER {_rows(5)} >= 2 THEN avg(turn_{m}) OVER {_rows(5)} END"
            f" AS zcr_{m}_5"
        )
    for n in (3, 5, 7):
        frames.append(
            f"max(distance_from_route_reported) OVER {_rows(n)} AS dist_roll_max_{n}"
        )
    joined = ",\n    ".join(frames)
    return f"""
moves AS (
  SELECT *,
    coalesce(temp_reported - lag(temp_reported) OVER ({_W}), 0e0) AS delta_temp,
    coalesce(humidity_reported - lag(humidity_reported) OVER ({_W}), 0e0) AS delta_hum,
    coalesce(distance_from_route_reported
      - lag(distance_from_route_reported) OVER ({_W}), 0e0) AS delta_dist
  FROM scored
),
turns AS (
  SELECT *,
    CAST(coalesce(sign(delta_temp) <> lag(sign(delta_temp)) OVER ({_W}), false) AS INTEGER)
      AS turn_temp,
    CAST(coalesce(sign(delta_hum) <> lag(sign(delta_hum)) OVER ({_W}), false) AS INTEGER)
      AS turn_hum
  FROM moves
),
sensor AS (
  SELECT *,
    {joined}
  FROM turns
)"""


def smoothed() -> str:
    def step(m: str, x: str) -> tuple[str, str]:
        faded = f"(s.w_{m} * (2e0 / 3e0))"
        mean = (
            f"CASE WHEN n.{x} IS NULL THEN s.m_{m} WHEN s.m_{m} IS NULL THEN n.{x}"
            f" ELSE ({faded} * s.m_{m} + n.{x} / 3e0) / ({faded} + 1e0 / 3e0) END"
        )
        weight = (
            f"CASE WHEN n.{x} IS NOT NULL THEN 1e0 WHEN s.m_{m} IS NULL THEN 1e0 ELSE {faded} END"
        )
        return mean, weight

    mt, wt = step("temp", "temp_reported")
    mh, wh = step("hum", "humidity_reported")
    return (
        TELEMETRY
        + ","
        + sensor()
        + f""",
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER ({_W}) AS rn FROM sensor
),
means AS (
  SELECT "Device_ID", rn, temp_reported AS m_temp, 1e0 AS w_temp,
    humidity_reported AS m_hum, 1e0 AS w_hum
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n."Device_ID", n.rn, {mt}, {wt}, {mh}, {wh}
  FROM means s JOIN numbered n ON n."Device_ID" = s."Device_ID" AND n.rn = s.rn + 1
),
resid AS (
  SELECT n.*, coalesce(temp_reported - m_temp, 0e0) AS temp_resid,
    coalesce(humidity_reported - m_hum, 0e0) AS hum_resid
  FROM numbered n JOIN means USING ("Device_ID", rn)
),
smoothed AS (
  SELECT *, temp_resid / (temp_roll_std_3 + 1e-6) AS temp_resid_std_ratio,
    hum_resid / (hum_roll_std_3 + 1e-6) AS hum_resid_std_ratio
  FROM resid
)"""
    )


def kinematic() -> str:
    speed_frames, accel_frames = [], []
    for n in (5, 12):
        enough = f"count(*) OVER {_rows(n)} >= 2"
        speed_frames += [
            f"coalesce(CASE WHEN {enough} THEN avg(speed_mps) OVER {_rows(n)} END, 0e0)"
            f" AS speed_mean_{n}",
            f"coalesce(stddev_samp(speed_mps) OVER {_rows(n)}, 0e0) AS speed_std_{n}",
        ]
        accel_frames.append(
            f"coalesce(stddev_samp(accel_mps2) OVER {_rows(n)}, 0e0) AS accel_std_{n}"
        )
    return f"""
legs AS (
  SELECT *,
    (epoch_us(timestamp_reported) - lag(epoch_us(timestamp_reported)) OVER ({_W})) / 1e6
      AS dt,
    lag(lat_reported) OVER ({_W}) AS lat0,
    lag(lon_reported) OVER ({_W}) AS lon0
  FROM scored
),
metres AS (
  SELECT *,
    2e0 * 6371000e0 * asin(sqrt(
      pow(sin(radians(lat_reported - lat0) / 2e0), 2e0)
      + cos(radians(lat0)) * cos(radians(lat_reported))
        * pow(sin(radians(lon_reported - lon0) / 2e0), 2e0))) AS moved
  FROM legs
),
speeds AS (
  SELECT *, coalesce(moved, 0e0) / greatest(coalesce(dt, 0e0), 1e0) AS speed_mps FROM metres
),
accels AS (
  SELECT *,
    coalesce((speed_mps - lag(speed_mps) OVER ({_W}))
      / CASE WHEN dt IS NOT NULL THEN greatest(dt, 1e0) END, 0e0) AS accel_mps2,
    CAST(speed_mps > 60 AS INTEGER) AS teleport_flag,
    {", ".join(speed_frames)}
  FROM speeds
),
kinematic AS (
  SELECT *, coalesce(accel_mps2 - lag(accel_mps2) OVER ({_W}), 0e0) AS jerk_mps3,
    {", ".join(accel_frames)}
  FROM accels
)"""


def replay(gps: bool = True) -> str:
    parts = ["round_even(temp_reported, 1)", "round_even(humidity_reported, 1)"]
    if gps:
        parts += ["round_even(lat_reported, 5)", "round_even(lon_reported, 5)"]
    same = " AND ".join(f"{p} IS NOT DISTINCT FROM lag({p}) OVER ({_W})" for p in parts)
    ratios = ", ".join(
        f"coalesce(CASE WHEN count(*) OVER {_rows(n)} >= 2"
        f" THEN avg(dup_flag) OVER {_rows(n)} END, 0e0) AS dup_ratio_{n}"
        for n in (5, 10)
    )
    return f"""
repeats AS (
  SELECT *, CAST(({same}) AND row_number() OVER ({_W}) > 1 AS INTEGER) AS dup_flag FROM scored
),
replay AS (SELECT *, {ratios} FROM repeats)"""


POINTS = (
    DECIDED
    + """,
stacked AS (
  SELECT 'temp' AS detector, score_temp AS score,
    CAST(primary_label_reported = 'Loss_of_storage_condition' AS INTEGER) AS truth FROM decided
  UNION ALL
  SELECT 'geo', score_geo, CAST(primary_label_reported = 'Geofence_anomaly' AS INTEGER)
  FROM decided
  UNION ALL
  SELECT 'tamper', score_tamper,
    CAST(primary_label_reported = 'Tamper_Damage_anomaly' AS INTEGER) FROM decided
  UNION ALL
  SELECT 'attack', score_attack_sup, is_cyber_true FROM decided
),
points AS (
  SELECT detector, score, sum(truth) AS pos, sum(1 - truth) AS neg
  FROM stacked GROUP BY detector, score
),
curve AS (
  SELECT *,
    sum(pos) OVER (PARTITION BY detector ORDER BY score DESC) AS tp,
    sum(neg) OVER (PARTITION BY detector ORDER BY score DESC) AS fp,
    sum(pos) OVER (PARTITION BY detector) AS npos,
    sum(neg) OVER (PARTITION BY detector) AS nneg,
    lead(pos) OVER (PARTITION BY detector ORDER BY score DESC) AS next_pos,
    lead(neg) OVER (PARTITION BY detector ORDER BY score DESC) AS next_neg,
    row_number() OVER (PARTITION BY detector ORDER BY score DESC) AS place
  FROM points
),
rates AS (
  SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / npos AS recall,
    CAST(fp AS DOUBLE) / nneg AS fpr
  FROM curve
),
traced AS (
  SELECT *,
    lag(recall, 1, 0e0) OVER w AS recall0, lag(precision, 1, 1e0) OVER w AS precision0,
    lag(fpr, 1, 0e0) OVER w AS fpr0
  FROM rates WINDOW w AS (PARTITION BY detector ORDER BY score DESC)
)"""
)


def report(truth: str, prediction: str) -> str:
    return f"""{DECIDED},
judged AS (SELECT {truth} AS t, {prediction} AS p FROM decided),
names AS (SELECT t AS label FROM judged UNION SELECT p FROM judged),
classes AS (
  SELECT label,
    (SELECT count(*) FROM judged WHERE t = label AND p = label) AS hit,
    (SELECT count(*) FROM judged WHERE t = label) AS actual,
    (SELECT count(*) FROM judged WHERE p = label) AS called
  FROM names
),
measured AS (
  SELECT label, CASE WHEN called = 0 THEN 0e0 ELSE hit / called END AS precision,
    CASE WHEN actual = 0 THEN 0e0 ELSE hit / actual END AS recall,
    CASE WHEN actual + called = 0 THEN 0e0 ELSE 2e0 * hit / (actual + called) END AS f1,
    actual AS support, hit
  FROM classes
),
report AS (
  SELECT label, precision, recall, f1, support FROM measured
  UNION ALL
  SELECT 'accuracy', NULL, NULL, sum(hit) / sum(support), CAST(sum(support) AS BIGINT)
  FROM measured
  UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT)
  FROM measured
  UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
    CAST(sum(support) AS BIGINT)
  FROM measured
)"""
