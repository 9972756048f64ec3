"""Per-device time bins over streamed predictions.

The batch operator and this one share their aggregation; a stream adds only the
watermark that says when a bin is final. State is one row per device and open
bin, so it is bounded by the devices and the allowed lateness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from frostline import settings as S
from frostline.operators.rollups import time_bins


def read_prediction_stream(
    spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int = 100
) -> DataFrame:
    """Saved predictions as they arrive in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def stream_time_bins(
    predictions: DataFrame, minutes: int = 5, lateness: str = "10 minutes"
) -> DataFrame:
    """Tumbling bins that are emitted once, when no more rows can reach them.
    Event-time watermarks need zoned times: times without zone are read as UTC
    and written as UTC, whatever the session's zone."""
    fields = ", ".join(f"{x}(`{S.RECEIVED}`)" for x in ("year", "month", "day", "hour", "minute"))
    seconds = f"extract(SECOND FROM `{S.RECEIVED}`)"
    zoned = predictions.withColumn(S.RECEIVED, F.expr(f"make_timestamp({fields}, {seconds}, 'UTC')"))
    bins = time_bins(zoned.withWatermark(S.RECEIVED, lateness), minutes)
    start = "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(timestamp))"
    return bins.withColumn("timestamp", F.expr(start))


def write_time_bins(
    bins: DataFrame, path: str, checkpoint: str, *, once: bool = False
) -> StreamingQuery:
    """Append finished bins; a restarted job goes on from its checkpoint."""
    writer = bins.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.format("parquet").start(path)
