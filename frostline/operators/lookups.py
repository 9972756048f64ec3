"""Joins of telemetry with per-device tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.operators.series import DEFAULT_SPLIT, SplitPolicy, measure

# a per-device row is a few dozen bytes, so this stays well below 100 MB
BROADCAST_ROWS = 500_000


def attach_per_device(
    facts: DataFrame,
    devices: DataFrame,
    key: str | list[str],
    *,
    broadcast_rows: int = BROADCAST_ROWS,
    policy: SplitPolicy = DEFAULT_SPLIT,
) -> DataFrame:
    """facts left-joined with one row per device, whatever the sizes.

    A device table of counted, bounded size is broadcast and the facts do not
    move. A larger one is shuffled; devices with very many facts would then
    flood single tasks, so their few rows are broadcast and only the rest moves.
    """
    if devices.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return facts.join(F.broadcast(devices), key, "left")
    keys = [key] if isinstance(key, str) else key
    sizes = measure(facts, keys)
    if sizes.largest <= policy.max_rows:
        return facts.join(devices, key, "left")
    limit = max(policy.max_rows, -(-sizes.total // policy.max_pieces))
    heavy = (
        facts.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > limit)
        .select(*keys)
    )
    # at most total / limit devices are heavy, hence bounded
    heavy_devices = devices.join(F.broadcast(heavy), key, "left_semi")
    many = facts.join(F.broadcast(heavy), key, "left_semi")
    few = facts.join(F.broadcast(heavy), key, "left_anti")
    return many.join(F.broadcast(heavy_devices), key, "left").unionByName(
        few.join(devices, key, "left")
    )


def replace_posture(
    telemetry: DataFrame,
    posture: DataFrame,
    key: str = "Device_ID",
    *,
    cvss_column: str = "cvss_max",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Telemetry with the posture columns of ``posture`` instead of its own,
    and the zero-filled ``*_used`` columns that the fusion model reads."""
    bare = telemetry.drop("cvss", "epss", "dvd")
    joined = attach_per_device(bare, posture, key, broadcast_rows=broadcast_rows)
    return joined.withColumns(
        {
            "cvss_used": F.coalesce(cvss_column, F.lit(0.0)),
            "epss_used": F.coalesce("epss_comb", F.lit(0.0)),
            "dvd_used": F.coalesce(F.col("dvd").cast("double"), F.lit(0.0)),
        }
    )
