"""Results out and back in: predictions, dashboard, posture, metadata."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline import settings as S
from frostline.settings import DecisionConfig, Persistence, Thresholds
from frostline.sources.telemetry import as_flag_value, require_columns

PREDICTIONS = "predictions"
DASHBOARD = "risk_dashboard"
INITIAL_POSTURE = "initial_posture"
FINAL_POSTURE = "final_posture_summary"
METADATA = "metadata"

POSTURE_SCHEMA = T.StructType(
    [
        T.StructField("Device_ID", T.StringType()),
        T.StructField("cvss", T.DoubleType()),
        T.StructField("epss", T.DoubleType()),
        T.StructField("dvd", T.DoubleType()),
        T.StructField("nist_gap_count", T.IntegerType()),
    ]
)
FINDINGS_SCHEMA = T.StructType(
    [
        T.StructField("Device_ID", T.StringType()),
        T.StructField("vuln_id", T.StringType()),
        T.StructField("cvss", T.DoubleType()),
        T.StructField("epss", T.DoubleType()),
    ]
)
DASHBOARD_SCHEMA = T.StructType(
    [
        T.StructField("Device_ID", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("has_cyber", T.IntegerType()),
        T.StructField("op_label_top", T.StringType()),
        T.StructField("max_op_score", T.DoubleType()),
        T.StructField("risk_mean", T.DoubleType()),
        T.StructField("cvss", T.DoubleType()),
        T.StructField("epss", T.DoubleType()),
        T.StructField("dvd", T.DoubleType()),
        T.StructField("rec_action", T.StringType()),
    ]
)
METADATA_SCHEMA = T.StructType(
    [
        T.StructField("persistence", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("thresholds", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField(
            "features",
            T.StructType(
                [T.StructField("attack_feats", T.ArrayType(T.StringType()))]
            ),
        ),
        T.StructField("notes", T.StringType()),
    ]
)


def read_posture(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTURE_SCHEMA).csv(path, header=True)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FINDINGS_SCHEMA).csv(path, header=True)


def write_by_day(
    df: DataFrame, path: str, *, format: str = "parquet", replace_all: bool = False, **options: object
) -> None:
    """One folder per day of the column ``date``. The days in df replace stored
    ones, other days stay, unless ``replace_all``. Rebalancing on the day keeps
    the files of a day few and lets the engine split a day that is too large for
    one task."""
    mode = "static" if replace_all else "dynamic"
    writer = df.hint("rebalance", "date").write.mode("overwrite").format(format)
    writer.options(partitionOverwriteMode=mode, **options).partitionBy("date").save(path)


def write_predictions(
    df: DataFrame, base: str, *, format: str = "parquet", replace_all: bool = False
) -> None:
    dated = df.withColumn("date", F.to_date(S.RECEIVED))
    options = {"header": True} if format == "csv" else {}
    write_by_day(
        dated, f"{base}/{PREDICTIONS}", format=format, replace_all=replace_all, **options
    )


def write_dashboard(df: DataFrame, base: str, *, format: str = "parquet") -> None:
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(f"{base}/{DASHBOARD}")


def write_posture(initial: DataFrame, summary: DataFrame, base: str) -> None:
    initial.write.mode("overwrite").parquet(f"{base}/{INITIAL_POSTURE}")
    summary.write.mode("overwrite").parquet(f"{base}/{FINAL_POSTURE}")


def metadata(
    spark: SparkSession,
    persistence: Persistence,
    thresholds: Thresholds,
    notes: str = "",
) -> DataFrame:
    """One row with the settings a run was made with."""
    row = (
        asdict(persistence),
        asdict(thresholds),
        (list(S.ATTACK_FEATURES),),
        notes,
    )
    return spark.createDataFrame([row], METADATA_SCHEMA)


def write_metadata(meta: DataFrame, base: str) -> None:
    meta.write.mode("overwrite").json(f"{base}/{METADATA}")


def read_metadata(spark: SparkSession, base: str) -> DataFrame:
    """The settings of a run; the JSON may be indented."""
    return spark.read.schema(METADATA_SCHEMA).json(f"{base}/{METADATA}", multiLine=True)


def decision_config(meta: DataFrame, config: DecisionConfig = DecisionConfig()) -> DecisionConfig:
    """``config`` with the persistence and thresholds that saved metadata names;
    what it does not name stays."""
    row = meta.first()
    if row is None:
        return config

    def named(base, found: dict | None):
        known = {k: v for k, v in (found or {}).items() if k in asdict(base) and v is not None}
        return replace(base, **known)

    return replace(
        config,
        persistence=named(config.persistence, row["persistence"]),
        thresholds=named(config.thresholds, row["thresholds"]),
    )


def read_dashboard(
    spark: SparkSession, base: str, *, format: str = "parquet"
) -> DataFrame:
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", True).schema(DASHBOARD_SCHEMA)
    return reader.load(f"{base}/{DASHBOARD}")


def read_predictions(
    spark: SparkSession, base: str, *, format: str = "parquet"
) -> DataFrame:
    reader = spark.read.format(format)
    if format == "csv":
        # types come from the column names, never from a pass over the data
        raw = reader.option("header", True).load(f"{base}/{PREDICTIONS}")
        typed = {
            "timestamp": "timestamp_ntz",
            "op_best_score": "double",
            "score_attack_sup": "double",
        }
        require_columns(raw, S.PREDICTION_COLUMNS)
        columns = {c: F.col(c).try_cast(t) for c, t in typed.items()}
        return raw.withColumns(columns | {"pred_attack_bin": as_flag_value("pred_attack_bin")})
    return require_columns(
        reader.load(f"{base}/{PREDICTIONS}"), S.PREDICTION_COLUMNS
    )


def read_results(
    spark: SparkSession, base: str, *, format: str = "parquet"
) -> dict[str, DataFrame | None]:
    """Every saved table by name; None for one that was not written. ``format``
    is that of the predictions and the dashboard."""
    readers = {
        PREDICTIONS: lambda: read_predictions(spark, base, format=format),
        DASHBOARD: lambda: read_dashboard(spark, base, format=format),
        INITIAL_POSTURE: lambda: spark.read.parquet(f"{base}/{INITIAL_POSTURE}"),
        FINAL_POSTURE: lambda: spark.read.parquet(f"{base}/{FINAL_POSTURE}"),
        METADATA: lambda: read_metadata(spark, base),
    }
    found: dict[str, DataFrame | None] = {}
    for name, read in readers.items():
        try:
            found[name] = read()
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            found[name] = None
    return found
