import random
from datetime import timedelta

from frostline.operators.decisions import decide
from frostline.operators.rollups import time_bins
from frostline.plans import fixture
from frostline.settings import DecisionConfig
from frostline.streaming.alerts import stream_alerts, write_alerts
from frostline.streaming.bins import (
    read_prediction_stream,
    stream_time_bins,
    write_time_bins,
)


def test_streamed_bins_equal_batch_bins_once_final(spark, sf_dir, tmp_path):
    decided = decide(fixture.scored_telemetry(spark, sf_dir))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    decided.orderBy("timestamp").coalesce(1).write.parquet(source)
    stream = read_prediction_stream(spark, source, decided.schema)
    query = write_time_bins(
        stream_time_bins(stream, lateness="1 minute"), out, str(tmp_path / "state"), once=True
    )
    assert query.awaitTermination(120)
    columns = ["Device_ID", "timestamp", "pred_attack_bin", "is_cyber_true"]
    streamed = {tuple(r) for r in spark.read.parquet(out).select(columns).collect()}
    batch = {tuple(r) for r in time_bins(decided).select(columns).collect()}
    # bins at the very end stay open until later rows push the watermark on
    assert streamed <= batch and len(batch) - len(streamed) <= 10


def test_streamed_alerts_equal_batch_alerts(spark, sf_dir, tmp_path):
    """Small files in a jumbled order, within the allowed lateness."""
    config = DecisionConfig(thresholds=fixture.FIXTURE_THRESHOLDS)
    scored = fixture.scored_telemetry(spark, sf_dir)
    batch = decide(scored, config)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = scored.orderBy("timestamp", "event_id").collect()
    times = [r["timestamp"] for r in rows]
    random.Random(3).shuffle(rows)
    # a row arrives up to a day late
    late = sorted(rows, key=lambda r: (r["timestamp"] + timedelta(hours=24 * random.Random(r["event_id"]).random())))
    for n in range(6):
        part = late[n * len(late) // 6 : (n + 1) * len(late) // 6]
        spark.createDataFrame(part, scored.schema).coalesce(1).write.mode("append").parquet(source)
    stream = read_prediction_stream(spark, source, scored.schema, files_per_trigger=1)
    query = write_alerts(stream_alerts(stream, config, lateness="24 hours"), out, str(tmp_path / "state"), once=True)
    assert query.awaitTermination(300)
    found = spark.read.parquet(out)
    columns = sorted(batch.columns)
    streamed = {r["event_id"]: tuple(r) for r in found.select(columns).collect()}
    expected = {r["event_id"]: tuple(r) for r in batch.select(columns).collect()}
    assert found.count() == len(streamed)
    assert all(expected[k] == v for k, v in streamed.items())
    final = {r["event_id"] for r in rows if r["timestamp"] <= max(times) - timedelta(hours=24, seconds=1)}
    assert final and final <= set(streamed)
    assert {r["pred_temp_bin"] for r in found.collect()} == {0, 1}
