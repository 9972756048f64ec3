"""Telemetry in: scan, validate, normalise, report what is available."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline import settings as S
from frostline.functions.expressions import nan_to_null


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """df itself, or an error that names the missing columns."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_existing(
    paths: Sequence[str], read: Callable[[str], DataFrame]
) -> DataFrame:
    """The first path that can be read; an error if none can."""
    for path in paths:
        try:
            return read(path)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")


def parse_timestamp(df: DataFrame, name: str, pattern: str | None) -> Column:
    """A lenient parse: text that does not match becomes null. Without a pattern
    ISO dates are expected; ambiguous day-month orders are never guessed."""
    col = F.col(name)
    if not isinstance(df.schema[name].dataType, T.StringType):
        return col.try_cast("timestamp_ntz")
    if pattern is None:
        return col.try_cast("timestamp_ntz")
    return F.try_to_timestamp(col, F.lit(pattern)).cast("timestamp_ntz")


_DEFAULTED = "defaulted"
_CLEAN = "clean_ids"
# the observed count of all rows
ROWS = "rows"


def carried(df: DataFrame, name: str) -> bool:
    """Whether the source itself has the column; defaults are marked as such."""
    return name in df.columns and not df.schema[name].metadata.get(_DEFAULTED, False)


def has_gps(df: DataFrame) -> bool:
    """Whether the source itself carries positions."""
    return carried(df, "lat_reported") and carried(df, "lon_reported")


def with_defaults(df: DataFrame) -> DataFrame:
    """Absent optional columns added and marked; nulls in present ones stay."""
    defaults: dict[str, Column] = {S.REPORTED: F.lit(None).cast("timestamp_ntz")}
    defaults |= {c: F.lit(0.0) for c in (*S.POSTURE_MEASURES, *S.SENSOR_MEASURES)}
    defaults |= {c: F.lit(0) for c in S.INTEGER_FLAGS}
    absent = [c.alias(n, metadata={_DEFAULTED: True}) for n, c in defaults.items() if n not in df.columns]
    return df.select("*", *absent) if absent else df


def normalise_device(df: DataFrame, *, missing_as: str | None = None) -> DataFrame:
    """Device id as trimmed text. ``missing_as`` names the device that rows
    without an id belong to; by default they keep a null id. Ids that
    `write_telemetry` has stored are clean already: they stay as they are, so that
    filters on them reach the files."""
    if df.schema[S.DEVICE].metadata.get(_CLEAN):
        return df
    device = F.trim(F.col(S.DEVICE).cast("string"))
    if missing_as is not None:
        device = F.coalesce(device, F.lit(missing_as))
    return df.withColumn(S.DEVICE, device)


def as_flag_value(name: str) -> Column:
    """A whole number, also where it is written as a decimal one."""
    return F.col(name).try_cast("double").try_cast("int")


def _typed(df: DataFrame, timestamp_pattern: str | None) -> dict[str, Column]:
    """The lenient typing of every column that is present."""
    times = [c for c in (S.RECEIVED, S.REPORTED) if c in df.columns]
    typed = {c: parse_timestamp(df, c, timestamp_pattern) for c in times}
    measures = (*S.POSTURE_MEASURES, *S.SENSOR_MEASURES)
    typed |= {c: F.col(c).try_cast("double") for c in measures if c in df.columns}
    # an integer column with gaps is often written as 1.0 and 0.0
    return typed | {c: as_flag_value(c) for c in S.INTEGER_FLAGS if c in df.columns}


def losses(df: DataFrame, *, timestamp_pattern: str | None = None) -> dict[str, Column]:
    """Per column, whether typing loses what a cell holds: it is neither null nor
    blank nor NaN and becomes null, or it is a flag with a fraction. A device is
    lost where there is no id."""
    found = {S.DEVICE: F.col(S.DEVICE).isNull()}
    for name, value in _typed(df, timestamp_pattern).items():
        held = F.trim(F.col(name).cast("string"))
        lost = (F.lower(held) != "nan") & (held != "") & value.isNull()
        if name in S.INTEGER_FLAGS:
            lost = lost | (F.col(name).try_cast("double") != value.cast("double"))
        found[name] = F.coalesce(lost, F.lit(False))
    return found


def normalise(
    df: DataFrame,
    *,
    timestamp_pattern: str | None = None,
    missing_device: str | None = "nan",
    observation: Observation | None = None,
) -> DataFrame:
    """Any table with the required columns as typed, defaulted telemetry. An
    ``observation`` counts rows and lost cells (see `losses`) in the pass of the
    first action on the result, without another scan."""
    require_columns(df, S.REQUIRED_COLUMNS)
    if observation is not None:
        lost = losses(df, timestamp_pattern=timestamp_pattern)
        counts = [F.count_if(c).alias(name) for name, c in lost.items()]
        df = df.observe(observation, F.count(F.lit(1)).alias(ROWS), *counts)
    rows = normalise_device(df, missing_as=missing_device)
    rows = with_defaults(nan_to_null(rows.withColumns(_typed(df, timestamp_pattern))))
    # stored defaults are still defaults
    marked = {c: {_DEFAULTED: True} for c in df.columns if df.schema[c].metadata.get(_DEFAULTED)}
    rows = rows.withColumns({c: F.col(c).alias(c, metadata=m) for c, m in marked.items()}) if marked else rows
    if S.ROW_ID not in rows.columns:
        # follows file and line order, so equal times keep their input order
        rows = rows.withColumn(S.ROW_ID, F.monotonically_increasing_id())
    return rows


def loss_report(spark: SparkSession, observation: Observation) -> DataFrame:
    """(column, lost, rows) of an observation that an action has filled."""
    counts = dict(observation.get)
    rows = counts.pop(ROWS)
    return spark.createDataFrame(
        [(name, lost, rows) for name, lost in counts.items()], "column string, lost long, rows long"
    )


def quarantined(df: DataFrame, *, timestamp_pattern: str | None = None) -> DataFrame:
    """The raw rows that typing loses something of, with the names of the lost
    columns in `lost`."""
    cells = losses(df, timestamp_pattern=timestamp_pattern).items()
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in cells]))
    return df.withColumn("lost", names).where(F.size("lost") > 0)


def write_telemetry(
    df: DataFrame,
    path: str,
    *,
    partitions: int | None = None,
    row_group_bytes: int | None = None,
    devices_per_row_group: int = 10_000,
) -> None:
    """Normalised telemetry as Parquet ranged and sorted by device and time. A
    device lies in few files and row groups, which statistics and a Bloom filter
    on the device tell apart; one with very many rows is cut by time. Filters on
    device and time reach the files when `read_telemetry` reads them."""
    clean = df.withColumn(S.DEVICE, F.col(S.DEVICE).alias(S.DEVICE, metadata={_CLEAN: True}))
    order = (S.DEVICE, S.RECEIVED)
    ranged = (
        clean.repartitionByRange(*order) if partitions is None else clean.repartitionByRange(partitions, *order)
    )
    writer = ranged.sortWithinPartitions(*order, S.ROW_ID).write.mode("overwrite").options(
        **{
            f"parquet.bloom.filter.enabled#{S.DEVICE}": "true",
            f"parquet.bloom.filter.expected.ndv#{S.DEVICE}": str(devices_per_row_group),
        }
    )
    if row_group_bytes is not None:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)


def read_telemetry(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    format: str = "csv",
    timestamp_pattern: str | None = None,
    devices: Sequence[str] | None = None,
    between: tuple[str, str] | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Telemetry from the first of the paths that exists, of all devices or some,
    and of all times or from the first to before the second of ``between``. CSV
    columns are read as text by header name and then typed leniently; columnar
    formats keep their own types. Over files of `write_telemetry` the filters on
    device and time reach the scan; elsewhere ids are trimmed and times parsed
    before they are compared."""
    candidates = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    raw = first_existing(candidates, reader.load)
    rows = normalise(raw, timestamp_pattern=timestamp_pattern, observation=observation)
    if devices is not None:
        rows = rows.where(F.col(S.DEVICE).isin(*devices))
    if between is not None:
        first, last = (F.lit(b).cast("timestamp_ntz") for b in between)
        rows = rows.where((F.col(S.RECEIVED) >= first) & (F.col(S.RECEIVED) < last))
    return rows


def feature_availability(df: DataFrame) -> DataFrame:
    """One row: positions present, any reported time known, tamper present, as
    the table stands (defaults count as present)."""
    reported = (
        F.coalesce(F.max(F.col(S.REPORTED).isNotNull()), F.lit(False))
        if S.REPORTED in df.columns
        else F.lit(False)
    )
    return df.agg(
        F.lit({"lat_reported", "lon_reported"} <= set(df.columns)).alias("gps"),
        reported.alias("timestamp_reported"),
        F.lit("tamper_reported" in df.columns).alias("tamper_reported"),
    )
