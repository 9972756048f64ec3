"""Alerts over streamed scores, where reports may arrive late and out of order.

Persistence counts consecutive raw flags of a device in time order, so a row can
only be judged when no earlier one can follow. State per device: the current run
of each detector, and the rows above the watermark. Once the watermark passes a
row, it is final: rows are judged in the order of (time, row id), as the batch
operator judges them. Rows that come after the watermark has passed their time
are dropped by the engine. State is bounded by the devices and the rows that
arrive within the allowed lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frostline import settings as S
from frostline.operators.decisions import TAMPERED, layers_after, layers_before
from frostline.settings import DecisionConfig

_DETECTORS = ("temp", "geo", "tamper", "attack")
_RUNS = [f"run_{d}" for d in _DETECTORS]
_RAW = [f"_raw_{d}" for d in _DETECTORS]
_PENDING = ["at", "id", *_RAW, "payload"]
_STATE = (
    ", ".join(f"{r} int" for r in _RUNS)
    + ", at array<long>, id array<long>, "
    + ", ".join(f"{r} array<int>" for r in _RAW)
    + ", payload array<string>"
)
_OUTPUT = "payload string, " + ", ".join(f"{r} int" for r in _RUNS)
_FORMAT = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _judge(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Rows up to the watermark, with the length of each detector's run."""
    if state.exists:
        old = state.get
        runs, lists = list(old[: len(_RUNS)]), old[len(_RUNS) :]
        waiting = [pd.DataFrame(dict(zip(_PENDING, map(list, lists), strict=True)))]
    else:
        runs, waiting = [0] * len(_RUNS), []
    waiting += [batch[_PENDING] for batch in batches]
    rows = pd.concat(waiting, ignore_index=True) if waiting else pd.DataFrame(columns=_PENDING)
    watermark = state.getCurrentWatermarkMs()
    final = rows["at"].astype("int64") // 1000 <= watermark
    ready = rows[final].sort_values(["at", "id"])
    found = []
    for payload, *raw in ready[["payload", *_RAW]].itertuples(index=False):
        runs = [run + 1 if flag else 0 for run, flag in zip(runs, raw, strict=True)]
        found.append((payload, *runs))
    rest = rows[~final]
    state.update((*map(int, runs), *(rest[c].tolist() for c in _PENDING)))
    if len(rest):
        # called again when the watermark has passed the earliest row
        state.setTimeoutTimestamp(max(int(rest["at"].min()) // 1000, watermark) + 1)
    yield pd.DataFrame(found, columns=["payload", *_RUNS])


def stream_alerts(
    scored: DataFrame,
    config: DecisionConfig = DecisionConfig(),
    lateness: str = "10 minutes",
    order_by: str = S.ROW_ID,
) -> DataFrame:
    """`decisions.decide` over a stream of scored telemetry: each row is emitted
    once, when it is final. Rows without device or time are dropped, as they
    belong to no series."""
    rows = scored.where(F.col(S.DEVICE).isNotNull() & F.col(S.RECEIVED).isNotNull())
    for layer in layers_before(config):
        rows = rows.withColumns({n: F.expr(e) for n, e in layer.items()})
    kept = [c for c in rows.columns if not c.startswith("_")]
    schema = rows.select(*kept).schema
    # event time needs a zone: times without one are read as UTC
    zoned = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{S.RECEIVED}`)")
    rows = rows.select(
        F.col(S.DEVICE).alias("device"),
        zoned.alias("at"),
        F.timestamp_micros(zoned).alias("event_time"),
        F.col(order_by).cast("long").alias("id"),
        *_RAW,
        F.to_json(F.struct(*kept), _FORMAT).alias("payload"),
    )
    judged = rows.withWatermark("event_time", lateness).groupBy("device").applyInPandasWithState(
        _judge, _OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    n = config.persistence
    needed = dict(zip(_DETECTORS, (n.temp, n.geo, n.tamper, n.attack), strict=True))
    held = {d: f"CAST(run_{d} >= {max(1, needed[d])} AS INT)" for d in _DETECTORS}
    rows = judged.withColumn("row", F.from_json("payload", schema, _FORMAT)).select("row.*", *_RUNS)
    rows = rows.withColumns(
        {
            "pred_temp_bin": F.expr(held["temp"]),
            "pred_geo_bin": F.expr(held["geo"]),
            "pred_tamper_bin": F.expr(f"greatest({held['tamper']}, {TAMPERED})"),
            "pred_attack_bin": F.expr(f"IF(high_risk, CAST(run_attack > 0 AS INT), {held['attack']})"),
        }
    ).drop(*_RUNS)
    for layer in layers_after(config):
        rows = rows.withColumns({name: F.expr(e) for name, e in layer.items()})
    return rows


def write_alerts(alerts: DataFrame, path: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Append final rows; a restarted job goes on from its checkpoint."""
    writer = alerts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.format("parquet").start(path)
