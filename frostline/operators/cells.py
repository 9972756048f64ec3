"""Mergeable cells of decided telemetry: device, day, label, action.

A cell holds counts, sums, maxima and the first row of its kind, so cells of
different runs, files or days merge by the same aggregate, and the dashboard, the
anomaly days, the device counters and the overview follow from cells alone. A day
has a handful of cells per device, however many reports came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.functions import expressions as X

DATE = "date"
CELL_KEYS = (S.DEVICE, DATE, "operational_label", "recommended_action")
# aggregate that merges each column of two cells
_MERGED = {
    "n": F.sum, "first": F.min, "scored": F.sum, "alerts": F.sum, "attacks": F.sum,
    "has_cyber": F.max, "max_op_score": F.max, "risk_sum": F.sum, "risk_n": F.sum,
} | dict.fromkeys(S.POSTURE_MEASURES, F.max)


def dated(df: DataFrame) -> DataFrame:
    """Rows that belong to a day, with that day."""
    return df.where(F.col(S.RECEIVED).isNotNull()).withColumn(DATE, F.to_date(S.RECEIVED))


def day_cells(decided: DataFrame, tie: str = S.ROW_ID) -> DataFrame:
    """The cells of decided rows. Rows without a time belong to no day."""
    return dated(decided).groupBy(*CELL_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(S.RECEIVED, F.col(tie).alias("tie"))).alias("first"),
        F.count("pred_attack_bin").alias("scored"),
        F.sum("pred_attack_bin").alias("alerts"),
        F.expr(f"sum({X.is_label(S.LABEL, S.CYBER)})").alias("attacks"),
        F.max("pred_attack_bin").alias("has_cyber"),
        F.max("op_best_score").alias("max_op_score"),
        F.sum("risk_score_combined").alias("risk_sum"),
        F.count("risk_score_combined").alias("risk_n"),
        *[F.max(c).alias(c) for c in S.POSTURE_MEASURES],
    )


def merge_cells(cells: DataFrame) -> DataFrame:
    """One cell per key from cells of any number of runs over different rows."""
    merged = cells.groupBy(*CELL_KEYS).agg(*[how(c).alias(c) for c, how in _MERGED.items()])
    return merged.select(*CELL_KEYS, *_MERGED)


def _mode_of(cells: str, field: str) -> str:
    """The most frequent value over an array of (value, n, first) cells; on equal
    counts the one seen first."""
    values = (
        f"array_distinct(filter(transform({cells}, c -> c.{field}), v -> v IS NOT NULL))"
    )
    of_value = f"filter({cells}, c -> c.{field} = v)"
    ranked = (
        f"transform({values}, v -> struct("
        f"-aggregate({of_value}, 0L, (a, c) -> a + c.n) AS n,"
        f" array_min(transform({of_value}, c -> c.first)) AS first, v AS value))"
    )
    return f"array_min({ranked}).value"


def dashboard_of(cells: DataFrame) -> DataFrame:
    """One row per device and day; cells of a key may lie in several rows."""
    days = cells.groupBy(S.DEVICE, DATE).agg(
        F.collect_list(
            F.struct(
                F.col("operational_label").alias("label"),
                F.col("recommended_action").alias("action"),
                "n",
                "first",
            )
        ).alias("_cells"),
        F.max("has_cyber").alias("has_cyber"),
        F.max("max_op_score").alias("max_op_score"),
        (F.sum("risk_sum") / F.sum("risk_n")).alias("risk_mean"),
        *[F.max(c).alias(c) for c in S.POSTURE_MEASURES],
    )
    return days.select(
        S.DEVICE,
        DATE,
        "has_cyber",
        F.expr(_mode_of("_cells", "label")).alias("op_label_top"),
        "max_op_score",
        "risk_mean",
        *S.POSTURE_MEASURES,
        F.expr(_mode_of("_cells", "action")).alias("rec_action"),
    )


def anomaly_days_of(cells: DataFrame) -> DataFrame:
    return cells.groupBy(S.DEVICE, DATE).agg(
        F.sum("alerts").alias("cyber_hits"),
        (F.max("has_cyber") > 0).cast("int").alias("cyber_days"),
        F.expr(f"max({X.is_anomaly('operational_label')})").alias("op_anom"),
        F.sum("scored").alias("n"),
    )


def device_counts_of(cells: DataFrame) -> DataFrame:
    return cells.groupBy(S.DEVICE).agg(
        F.sum("alerts").alias("pred_cyber_flags"),
        F.sum("attacks").alias("true_cyber"),
        F.sum("n").alias("records"),
    )


def top_labels_of(cells: DataFrame, k: int = 3) -> DataFrame:
    counted = cells.groupBy(S.DEVICE, "operational_label").agg(F.sum("n").alias("count"))
    place = Window.partitionBy(S.DEVICE).orderBy(F.desc("count"), "operational_label")
    ranked = counted.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
    return ranked.select(S.DEVICE, "operational_label", "count", "place")


# -- one row per day, with the devices as a sketch ----------------------------------
SKETCH_BITS = 14


def day_totals(cells: DataFrame) -> DataFrame:
    """Per day: rows, attacks, alerts, and a HyperLogLog sketch of its devices
    (2^14 registers, about 16 KB, relative standard error below 1 %)."""
    devices = cells.where(F.col(S.DEVICE).isNotNull()).groupBy(DATE)
    sketches = devices.agg(F.hll_sketch_agg(S.DEVICE, F.lit(SKETCH_BITS)).alias("devices"))
    totals = cells.groupBy(DATE).agg(
        F.sum("n").alias("rows"), F.sum("attacks").alias("attacks"), F.sum("alerts").alias("alerts")
    )
    return totals.join(sketches, DATE, "left").select(DATE, "rows", "attacks", "alerts", "devices")


def overview_of(totals: DataFrame, *by: Column | str) -> DataFrame:
    """Devices (estimated), rows, cyber prevalence and alerts of stored days, in
    one row or by a grouping. Only the days' rows are read."""
    found = totals.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("devices", F.lit(True))).alias("devices"),
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum("attacks") / F.sum("rows"), F.lit(0.0)).alias("cyber_prevalence"),
        F.coalesce(F.sum("alerts"), F.lit(0)).alias("cyber_alerts"),
    )
    return found.withColumns(
        {"devices": F.coalesce("devices", F.lit(0)), "rows": F.coalesce("rows", F.lit(0))}
    )
