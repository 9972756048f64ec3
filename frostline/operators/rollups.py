"""Device, device-day and time-bin rollups of decided telemetry.

Every aggregate here combines on the map side, so a device or day with a large
share of the rows reaches the shuffle as a few partial rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.functions import expressions as X
from frostline.operators.cells import dashboard_of, dated, day_cells
from frostline.settings import BumpPolicy


# -- modes --------------------------------------------------------------------
def most_frequent(
    df: DataFrame, keys: Sequence[str], value: str, tie: str = S.ROW_ID
) -> DataFrame:
    """Per group the most frequent value; on equal counts the one seen first."""
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(F.struct(F.col(S.RECEIVED), F.col(tie))).alias("_first"),
        )
    )
    place = F.struct(-F.col("_n"), F.col("_first"), F.col(value))
    return counted.groupBy(*keys).agg(F.min_by(value, place).alias(value))


# -- device-day ---------------------------------------------------------------
def risk_dashboard(decided: DataFrame, tie: str = S.ROW_ID) -> DataFrame:
    """One row per device and day. Rows are first reduced per label and action
    (a handful per device-day), from which both modes and all maxima follow."""
    return dashboard_of(day_cells(decided, tie))


def anomaly_days(decided: DataFrame) -> DataFrame:
    return (
        dated(decided)
        .groupBy(S.DEVICE, "date")
        .agg(
            F.sum("pred_attack_bin").alias("cyber_hits"),
            (F.max("pred_attack_bin") > 0).cast("int").alias("cyber_days"),
            F.expr(f"max({X.is_anomaly('operational_label')})").alias("op_anom"),
            F.count("pred_attack_bin").alias("n"),
        )
    )


def anomaly_summary(days: DataFrame) -> DataFrame:
    return days.groupBy(S.DEVICE).agg(
        F.sum("cyber_days").alias("cyber_days"),
        F.sum("cyber_hits").alias("cyber_total"),
        F.sum("op_anom").alias("op_days"),
        F.sum("n").alias("samples"),
    )


# -- posture ------------------------------------------------------------------
_COUNTS = ("cyber_days", "cyber_total", "op_days", "samples")


def join_summary(posture: DataFrame, summary: DataFrame) -> DataFrame:
    """Every device of the posture table; one without reports counts zero."""
    return posture.join(summary, S.DEVICE, "left").na.fill(0, list(_COUNTS))


def bump_posture(joined: DataFrame, policy: BumpPolicy = BumpPolicy()) -> DataFrame:
    p = policy
    epss = (
        f"least({X.real(p.epss_bump_max)}, {X.real(p.epss_per_day)} * cyber_days"
        f" + {X.real(p.epss_per_hit)} * cyber_total)"
    )
    dvd = f"least({X.real(p.dvd_bump_max)}, {X.real(p.dvd_per_day)} * op_days)"
    cvss = (
        f"IF(cvss < {X.real(p.cvss_below)} AND cyber_days >= {p.cvss_min_days},"
        f" {X.real(p.cvss_bump)}, 0D)"
    )
    return joined.withColumns(
        {
            "cvss_final": F.expr(X.clip(f"cvss + {cvss}", 0.0, p.cvss_max)),
            "epss_final": F.expr(X.clip(f"epss + {epss}", 0.0, p.epss_max)),
            "dvd_final": F.expr(X.clip(f"dvd + {dvd}", 0.0, p.dvd_max)),
        }
    )


def posture_summary(bumped: DataFrame) -> DataFrame:
    final = [f"{c}_final" for c in S.POSTURE_MEASURES]
    return bumped.select(S.DEVICE, *S.POSTURE_MEASURES, *final, *_COUNTS)


def update_posture(
    posture: DataFrame, decided: DataFrame, policy: BumpPolicy = BumpPolicy()
) -> DataFrame:
    summary = anomaly_summary(anomaly_days(decided))
    return posture_summary(bump_posture(join_summary(posture, summary), policy))


def posture_deltas(summary: DataFrame) -> DataFrame:
    deltas = {
        f"delta_{c}": F.col(f"{c}_final") - F.col(c) for c in S.POSTURE_MEASURES
    }
    return summary.drop("cyber_total").withColumns(deltas)


def largest_increases(deltas: DataFrame, measure: str, k: int = 10) -> DataFrame:
    return deltas.orderBy(F.desc(f"delta_{measure}"), S.DEVICE).limit(k)


def by_increase(deltas: DataFrame) -> DataFrame:
    return deltas.orderBy(
        F.desc("delta_epss"), F.desc("delta_dvd"), F.desc("delta_cvss"), S.DEVICE
    )


def posture_from_findings(findings: DataFrame) -> DataFrame:
    """Chance that at least one finding is exploited, and severity statistics."""
    missed = F.lit(1.0) - F.coalesce("epss", F.lit(0.0))
    return (
        findings.where(F.col(S.DEVICE).isNotNull())
        .groupBy(S.DEVICE)
        .agg(
            F.avg("cvss").alias("cvss_mean"),
            F.max("cvss").alias("cvss_max"),
            (F.lit(1.0) - F.product(missed)).alias("epss_comb"),
            F.countDistinct("vuln_id").alias("dvd"),
        )
    )


def posture_from_telemetry(telemetry: DataFrame) -> DataFrame:
    return (
        telemetry.where(F.col(S.DEVICE).isNotNull())
        .groupBy(S.DEVICE)
        .agg(
            F.avg("cvss").alias("cvss_mean"),
            F.avg("epss").alias("epss_comb"),
            F.avg("dvd").alias("dvd"),
            F.max("cvss").alias("cvss_max"),
        )
    )


# -- overview and device view ---------------------------------------------------
def overview(decided: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Devices, rows, cyber prevalence and alerts in one row."""
    devices = F.approx_count_distinct if approximate else F.countDistinct
    truth = F.expr(X.is_label(S.LABEL, S.CYBER))
    return decided.agg(
        devices(S.DEVICE).alias("devices"),
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.avg(truth), F.lit(0.0)).alias("cyber_prevalence"),
        F.coalesce(F.sum("pred_attack_bin"), F.lit(0)).alias("cyber_alerts"),
    )


def device_ids(df: DataFrame) -> DataFrame:
    return df.select(F.col(S.DEVICE).cast("string").alias(S.DEVICE)).distinct().orderBy(S.DEVICE)


def select_devices(
    df: DataFrame, devices: Sequence[str] | None = None, default_first: int = 10
) -> DataFrame:
    """Rows of the given devices, by default of the first ten by id."""
    if devices is not None:
        return df.where(F.col(S.DEVICE).isin(*devices))
    first = device_ids(df).limit(default_first)
    return df.join(F.broadcast(first), S.DEVICE, "left_semi")


def device_timeline(df: DataFrame, device: str, tie: str = S.ROW_ID) -> DataFrame:
    return df.where(F.col(S.DEVICE) == device).orderBy(S.RECEIVED, tie)


def flagged(df: DataFrame) -> DataFrame:
    return df.where(F.col("pred_attack_bin") > 0)


def device_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy(S.DEVICE).agg(
        F.sum("pred_attack_bin").alias("pred_cyber_flags"),
        F.expr(f"sum({X.is_label(S.LABEL, S.CYBER)})").alias("true_cyber"),
        F.count(F.lit(1)).alias("records"),
    )


def top_labels(decided: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent operational labels of every device."""
    counted = decided.groupBy(S.DEVICE, "operational_label").count()
    place = Window.partitionBy(S.DEVICE).orderBy(F.desc("count"), "operational_label")
    return (
        counted.withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= k)
        .select(S.DEVICE, "operational_label", "count", "place")
    )


def hourly_labels(
    decided: DataFrame,
    labels: Sequence[str] = (S.NORMAL, *S.OPERATIONAL_LABELS),
    device: str | None = None,
) -> DataFrame:
    """Hour by label counts, of all devices or one. The label list is given, so
    no extra pass finds it; labels outside it, and none, count as `other`."""
    if device is not None:
        decided = decided.where(F.col(S.DEVICE) == device)
    known = F.col("operational_label").isin(*labels)
    label = F.when(known, F.col("operational_label")).otherwise(F.lit("other"))
    labels = [*labels, "other"]
    return (
        decided.where(F.col(S.RECEIVED).isNotNull())
        .withColumn("operational_label", label)
        .groupBy(F.expr(X.hour_of(S.RECEIVED)).alias("hour"))
        .pivot("operational_label", labels)
        .count()
        .na.fill(0, labels)
    )


def long_labels(pivoted: DataFrame) -> DataFrame:
    labels = [c for c in pivoted.columns if c != "hour"]
    return pivoted.unpivot(["hour"], labels, "operational_label", "count")


# -- dashboard view ---------------------------------------------------------------
def date_bounds(dashboard: DataFrame) -> DataFrame:
    return dashboard.agg(F.min("date").alias("first"), F.max("date").alias("last"))


def filter_dashboard(
    dashboard: DataFrame,
    between: tuple[str, str] | None = None,
    devices: Sequence[str] = (),
) -> DataFrame:
    """Inclusive date range (default: everything dated) and optional devices."""
    rows = dashboard.where(F.col("date").isNotNull())
    if between is not None:
        first, last = (F.to_date(F.lit(b)) for b in between)
        rows = rows.where(F.col("date").between(first, last))
    if devices:
        rows = rows.where(F.col(S.DEVICE).isin(*devices))
    return rows


def cyber_days(dashboard: DataFrame) -> DataFrame:
    return dashboard.groupBy(S.DEVICE).agg(F.sum("has_cyber").alias("cyber_days"))


# -- false alarms -------------------------------------------------------------------
def _false_alarms_per_day(df: DataFrame, prediction: str, truth: Column) -> DataFrame:
    wrong = ((F.col(prediction) == 1) & (truth == 0)).cast("int")
    return (
        dated(df)
        .groupBy(S.DEVICE, "date")
        .agg(F.sum(F.coalesce(wrong, F.lit(0))).alias("fp"))
    )


def false_alarms_per_device(df: DataFrame, prediction: str) -> DataFrame:
    """Mean false alarms per day of each device, against 'not normal'."""
    truth = F.expr(X.is_anomaly(S.LABEL))
    daily = _false_alarms_per_day(df, prediction, truth)
    return daily.groupBy(S.DEVICE).agg(F.avg("fp").alias("avg_fp_per_day"))


def false_alarm_rate(df: DataFrame, prediction: str) -> DataFrame:
    """Mean false alarms per device-day over all device-days."""
    truth = F.expr(X.is_anomaly(S.LABEL))
    daily = _false_alarms_per_day(df, prediction, truth)
    return daily.agg(F.coalesce(F.avg("fp"), F.lit(0.0)).alias("avg_fp_per_device_day"))


# -- time bins ------------------------------------------------------------------------
def time_bins(decided: DataFrame, minutes: int = 5) -> DataFrame:
    """Tumbling bins per device: mean score, any alert, any true attack."""
    return (
        decided.where(F.col(S.RECEIVED).isNotNull())
        .groupBy(S.DEVICE, F.window(S.RECEIVED, f"{minutes} minutes").alias("_bin"))
        .agg(
            F.avg("score_attack_sup").alias("score_attack_sup"),
            F.max("pred_attack_bin").alias("pred_attack_bin"),
            F.expr(f"max({X.is_label(S.LABEL, S.CYBER)})").alias("is_cyber_true"),
        )
        .select(
            S.DEVICE,
            F.col("_bin.start").alias("timestamp"),
            "score_attack_sup",
            "pred_attack_bin",
            "is_cyber_true",
        )
    )


# bins that one generated array holds at most
BLOCK_BINS = 1024


def fill_bins(bins: DataFrame, minutes: int = 5) -> DataFrame:
    """Empty bins between a device's first and last one, with null values. Each
    bin emits the gap behind it, so no spine is built and joined. A gap is first
    cut into stretches of bins, stretches into blocks, and blocks into bins, so a
    gap of decades (one wrong clock) makes no array of more than `BLOCK_BINS`
    elements for each level."""
    ahead = Window.partitionBy(S.DEVICE).orderBy("timestamp")
    gap = F.timestamp_diff("MINUTE", F.col("timestamp"), F.lead("timestamp").over(ahead)) / minutes
    values = ("score_attack_sup", "pred_attack_bin", "is_cyber_true")
    rows = bins.select(
        S.DEVICE, "timestamp", *values, F.coalesce(F.floor(gap), F.lit(1)).cast("long").alias("_size")
    ).withColumn("_place", F.lit(0).cast("long"))
    for width in (BLOCK_BINS * BLOCK_BINS, BLOCK_BINS, 1):
        # places of this row's bins, a stretch of `width` each
        starts = F.sequence(F.lit(0).cast("long"), F.col("_size") - 1, F.lit(width).cast("long"))
        rows = rows.select(
            S.DEVICE, "timestamp", *values, "_size", "_place", F.explode(starts).alias("_start")
        ).withColumns(
            {
                "_place": F.col("_place") + F.col("_start"),
                "_size": F.least(F.lit(width), F.col("_size") - F.col("_start")),
            }
        )
    at = F.timestamp_add("MINUTE", (F.col("_place") * minutes).cast("int"), F.col("timestamp"))
    return rows.select(
        S.DEVICE,
        at.alias("timestamp"),
        *[F.when(F.col("_place") == 0, F.col(c)).alias(c) for c in values],
    )
