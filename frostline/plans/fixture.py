"""The telemetry, posture and findings tables, derived from the given ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline import settings as S
from frostline.settings import Thresholds

# the geofence cut is lowered so that runs of four rows are common here
FIXTURE_THRESHOLDS = Thresholds(
    temp=0.3483, geo=0.5, tamper=1.0, attack_sup_base=0.446454
)


def real(value: float) -> Column:
    return F.lit(float(value))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _device() -> Column:
    return F.concat(
        F.lit("D"), F.lpad((F.col("user_id") % 10 + 1).cast("string"), 3, "0")
    )


def _telemetry_columns() -> list[Column]:
    k, kind, value = _k(), F.col("event_type"), F.col("value")
    d = (F.col("user_id") % 10).cast("int")
    band = F.floor(k / 50).cast("double")
    tampered = (kind == "signup") & (k % 10 == 0)
    label = (
        F.when(kind == "error", S.CYBER)
        .when((kind == "purchase") & (value >= real(100)), S.STORAGE)
        .when(tampered, S.TAMPER)
        .when((kind == "signup") & (k % 10 == 1), S.GEOFENCE)
        .otherwise(S.NORMAL)
    )
    reported = F.when(k != 99, F.col("ts") - F.make_dt_interval(mins=(k % 20) * 3))
    temp = F.when(k != 98, real(2) + F.floor(value / real(25)) * real(0.5))
    return [
        _device().alias(S.DEVICE),
        F.col("ts").alias(S.RECEIVED),
        reported.alias(S.REPORTED),
        temp.alias("temp_reported"),
        (real(40) + band * real(5)).alias("humidity_reported"),
        (value * real(10)).alias("distance_from_route_reported"),
        (real(40) + d / real(100) + band * real(0.5)).alias("lat_reported"),
        (real(-70) - d / real(100) - band * real(0.5)).alias("lon_reported"),
        tampered.cast("int").alias("tamper_reported"),
        (F.col("event_id") % 7 == 0).cast("int").alias("is_augmented"),
        label.alias(S.LABEL),
        (d * real(1.1)).alias("cvss"),
        (((d * 37) % 100) / real(100)).alias("epss"),
        (d % 7).cast("double").alias("dvd"),
        F.col("event_id").alias(S.ROW_ID),
    ]


def _score_columns() -> list[Column]:
    """Deterministic stand-ins for the detector scores, on a grid of 1e-4, so
    that the decision layer has an exact SQL counterpart."""
    k, value = _k(), F.col("value")
    error = F.when(F.col("event_type") == "error", real(40)).otherwise(real(0))

    def score(x: Column) -> Column:
        return F.round(F.least(real(1), x), 4)

    return [
        score(value / real(150)).alias("score_temp"),
        score((k + value / real(10)) / real(110)).alias("score_geo"),
        score(k / real(99)).alias("score_tamper"),
        score((k + error) / real(139)).alias("score_attack_sup"),
    ]


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*_telemetry_columns())


def scored_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        *_telemetry_columns(), *_score_columns()
    )


def posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per device with its initial security posture."""
    return (
        telemetry(spark, sf_dir)
        .groupBy(S.DEVICE)
        .agg(*[F.max(c).alias(c) for c in S.POSTURE_MEASURES])
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vulnerability findings, many per device."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias(S.DEVICE),
        F.col("l_partkey").cast("string").alias("vuln_id"),
        (F.col("l_quantity") / real(5)).alias("cvss"),
        F.col("l_discount").alias("epss"),
    )


def finding_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows as reports of the devices that the findings speak of."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias(S.DEVICE),
        F.col("o_orderdate").alias(S.RECEIVED),
        F.col("o_totalprice").alias("distance_from_route_reported"),
        *[F.lit(None).cast("double").alias(c) for c in S.POSTURE_MEASURES],
        F.col("o_orderkey").alias(S.ROW_ID),
    )
