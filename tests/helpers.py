"""Small hand-made telemetry and the features by definition, row by row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("Device_ID", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("timestamp_reported", T.TimestampNTZType()),
        T.StructField("temp_reported", T.DoubleType()),
        T.StructField("humidity_reported", T.DoubleType()),
        T.StructField("distance_from_route_reported", T.DoubleType()),
        T.StructField("lat_reported", T.DoubleType()),
        T.StructField("lon_reported", T.DoubleType()),
        T.StructField("tamper_reported", T.IntegerType()),
        T.StructField("is_augmented", T.IntegerType()),
        T.StructField("primary_label_reported", T.StringType()),
        T.StructField("cvss", T.DoubleType()),
        T.StructField("epss", T.DoubleType()),
        T.StructField("dvd", T.DoubleType()),
        T.StructField("event_id", T.LongType()),
    ]
)

LABELS = [
    "normal",
    "Loss_of_storage_condition",
    "Geofence_anomaly",
    "Tamper_Damage_anomaly",
    "Cyberattack_anomaly",
]


def random_telemetry(rows: int, devices: int, seed: int, skew: float = 0.5) -> pd.DataFrame:
    """Random reports with missing values, equal times, repeated readings and
    out-of-order device clocks; ``skew`` of the rows belong to one device."""
    rng = np.random.default_rng(seed)
    device = np.where(
        rng.random(rows) < skew, 0, rng.integers(0, devices, rows)
    )
    minute = rng.integers(0, rows // 2, rows)
    base = pd.Timestamp("2024-03-01")
    received = base + pd.to_timedelta(minute * 7, unit="s")
    reported = received - pd.to_timedelta(rng.integers(0, 900, rows), unit="s")

    def holes(values, share):
        return np.where(rng.random(rows) < share, np.nan, values)

    spot = rng.integers(0, 3, rows)
    frame = pd.DataFrame(
        {
            "Device_ID": [f"D{d:03d}" for d in device],
            "timestamp": received,
            "timestamp_reported": pd.Series(reported).mask(rng.random(rows) < 0.1),
            "temp_reported": holes(rng.integers(2, 5, rows) / 2.0, 0.15),
            "humidity_reported": holes(40.0 + 5.0 * rng.integers(0, 2, rows), 0.05),
            "distance_from_route_reported": holes(rng.random(rows) * 100, 0.05),
            "lat_reported": holes(40.0 + spot * 0.01, 0.05),
            "lon_reported": holes(-70.0 - spot * 0.01, 0.05),
            "tamper_reported": (rng.random(rows) < 0.05).astype(int),
            "is_augmented": (rng.random(rows) < 0.1).astype(int),
            "primary_label_reported": rng.choice(LABELS, rows, p=[0.6, 0.1, 0.1, 0.1, 0.1]),
            "cvss": device * 1.7 % 10,
            "epss": device * 0.23 % 1,
            "dvd": (device % 7).astype(float),
            "event_id": rng.permutation(rows),
        }
    )
    # a long stretch without temperature on the busiest device
    busy = frame.index[frame["Device_ID"] == "D000"]
    frame.loc[busy[len(busy) // 3 : len(busy) // 3 + 40], "temp_reported"] = np.nan
    return frame


def to_spark(spark, frame: pd.DataFrame, schema: T.StructType = SCHEMA):
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, pd.Timestamp):
            return v.to_pydatetime()
        return v.item() if isinstance(v, np.generic) else v

    names = schema.fieldNames()
    rows = [tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, schema)


# -- the features once more, by definition, row by row ---------------------------


def expected_features(frame: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for _, device in frame.groupby("Device_ID"):
        ordered = device.sort_values(["timestamp", "event_id"])
        rows += _device_rows(ordered.to_dict("list"), len(ordered))
    return pd.DataFrame(rows)


def _known(values):
    return [v for v in values if v is not None and not math.isnan(v)]


def _spread(values, *, sample: bool):
    """Standard deviation; unknown for a single sample value."""
    n = len(values) - (1 if sample else 0)
    if n < 1:
        return math.nan
    centre = math.fsum(values) / len(values)
    return math.sqrt(math.fsum((v - centre) ** 2 for v in values) / n)


def _or_zero(value):
    return 0.0 if math.isnan(value) else value


def _steps(values):
    return [math.nan] + [b - a for a, b in zip(values, values[1:])]


def _metres(lat0, lon0, lat1, lon1):
    """Great-circle distance by the chord between unit vectors."""
    a, b, c, d = (math.radians(v) for v in (lat0, lon0, lat1, lon1))
    p = np.array([math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)])
    q = np.array([math.cos(c) * math.cos(d), math.cos(c) * math.sin(d), math.sin(c)])
    return 2 * 6371000.0 * math.asin(min(1.0, float(np.linalg.norm(p - q)) / 2))


def _smoothed(values):
    """Exponentially weighted means with alpha 1/3, weights spelled out: the
    latest known value has weight 1/3 against everything before, and what came
    before has faded by 2/3 for every row since."""
    means, mean, since = [], math.nan, 0
    for v in values:
        since += 1
        if not math.isnan(v):
            if math.isnan(mean):
                mean = v
            else:
                old = (2 / 3) ** since
                mean = (old * mean + v / 3) / (old + 1 / 3)
            since = 0
        means.append(mean)
    return means


def _device_rows(c: dict, n: int) -> list[dict]:
    def minutes(a, b):
        return math.nan if pd.isna(a) or pd.isna(b) else (b - a).total_seconds() / 60

    def window(values, i, size):
        return values[max(0, i - size + 1) : i + 1]

    sent, got = c["timestamp_reported"], c["timestamp"]
    delay = [minutes(s, g) for s, g in zip(sent, got)]
    sent_gap = [math.nan] + [minutes(a, b) for a, b in zip(sent, sent[1:])]
    got_gap = [math.nan] + [minutes(a, b) for a, b in zip(got, got[1:])]
    temp, hum = c["temp_reported"], c["humidity_reported"]
    dist, lat, lon = c["distance_from_route_reported"], c["lat_reported"], c["lon_reported"]

    speed, accel = [], []
    for i in range(n):
        here = (lat[i - 1], lon[i - 1], lat[i], lon[i]) if i else (math.nan,) * 4
        moved = 0.0 if any(map(math.isnan, here)) else _metres(*here)
        elapsed = sent_gap[i] * 60
        speed.append(moved / max(_or_zero(elapsed), 1.0))
        known = i and not math.isnan(elapsed)
        accel.append((speed[i] - speed[i - 1]) / max(elapsed, 1.0) if known else 0.0)

    def place(i):
        return (round(lat[i], 5), round(lon[i], 5))

    def reading(i):
        values = (round(lat[i], 5), round(lon[i], 5), round(temp[i], 1), round(hum[i], 1))
        return tuple(map(str, values))  # a missing part equals a missing part

    same = [int(i > 0 and place(i) == place(i - 1)) for i in range(n)]
    again = [int(i > 0 and reading(i) == reading(i - 1)) for i in range(n)]
    deltas = {"temp": temp, "hum": hum, "dist": dist}
    deltas = {m: [_or_zero(d) for d in _steps(v)] for m, v in deltas.items()}
    signs = {m: [(d > 0) - (d < 0) for d in deltas[m]] for m in ("temp", "hum")}
    smooth = {"temp": _smoothed(temp), "hum": _smoothed(hum)}

    rows = []
    for i in range(n):
        row = {
            "event_id": c["event_id"][i],
            "delay_min": delay[i],
            "delay_big": int(delay[i] >= 5),
            "rpt_gap_min": sent_gap[i],
            "rcv_gap_min": got_gap[i],
            "gap_err_min": _or_zero(sent_gap[i] - got_gap[i]),
            "reported_ts_diff_min": _or_zero(sent_gap[i]),
            "rpt_ooo": int(sent_gap[i] < 0),
            "gps_same": same[i],
            "gps_repeat_count": next(k for k in range(n + 1) if k > i or not same[i - k]),
            "speed_mps": speed[i],
            "accel_mps2": accel[i],
            "jerk_mps3": accel[i] - accel[i - 1] if i else 0.0,
            "teleport_flag": int(speed[i] > 60),
            "dup_flag": again[i],
        }
        row["gps_repeat_cap10"] = min(10, row["gps_repeat_count"])
        recent = sorted(_known(window(delay, i, 12)))
        enough = len(recent) >= 3
        row["delay_med_1h"] = float(np.median(recent)) if enough else math.nan
        row["delay_std_1h"] = _spread(recent, sample=True) if enough else math.nan
        for name, gaps in (("rpt", sent_gap), ("rcv", got_gap)):
            recent = _known(window(gaps, i, 5))
            row[f"{name}_gap_cv_5"] = 0.0
            if len(recent) >= 3:
                centre = math.fsum(recent) / len(recent)
                row[f"{name}_gap_cv_5"] = (_spread(recent, sample=False) + 1e-6) / (centre + 1e-6)
        for m, values in (("temp", temp), ("hum", hum)):
            for w in (3, 5, 7):
                recent = _known(window(values, i, w))
                row[f"{m}_roll_mean_{w}"] = math.fsum(recent) / len(recent) if recent else math.nan
                row[f"{m}_roll_std_{w}"] = _or_zero(_spread(recent, sample=True))
            row[f"{m}_var_5"] = _or_zero(_spread(_known(window(values, i, 5)), sample=True)) ** 2
            row[f"{m}_resid"] = _or_zero(values[i] - smooth[m][i])
            turned = [int(k > 0 and signs[m][k] != signs[m][k - 1]) for k in range(max(0, i - 4), i + 1)]
            row[f"zcr_{m}_5"] = sum(turned) / len(turned) if i else math.nan
        for m in deltas:
            row[f"delta_{m}"] = deltas[m][i]
        for w in (3, 5, 7):
            recent = _known(window(dist, i, w))
            row[f"dist_roll_max_{w}"] = max(recent) if recent else math.nan
        for w in (5, 12):
            recent = window(speed, i, w)
            row[f"speed_mean_{w}"] = math.fsum(recent) / len(recent) if i else 0.0
            row[f"speed_std_{w}"] = _or_zero(_spread(recent, sample=True))
            row[f"accel_std_{w}"] = _or_zero(_spread(window(accel, i, w), sample=True))
        for w in (5, 10):
            recent = window(again, i, w)
            row[f"dup_ratio_{w}"] = sum(recent) / len(recent) if i else 0.0
        rows.append(row)
    return rows
