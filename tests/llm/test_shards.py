"""Every row once, equal shards, gapless slots, a seeded order."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from frostline.llm import common, shards


def run(spark, rows, n, **options):
    path = common.new_path(spark, "shards")
    frame = spark.createDataFrame([(*x, "p") for x in rows], "doc_id long, text string, position string").repartition(3)
    shards.shard(frame, n, path, **options)
    return spark.read.schema(
        "record struct<doc_id: long, text: string, position: string>, position long, slot long, shard int"
    ).parquet(path).collect()


@pytest.mark.parametrize(("count", "n", "bucket"), [(100, 7, 200), (100, 24, 1 << 20), (5, 24, 40), (48, 24, 100)])
def test_equal_shards(spark, count, n, bucket):
    rows = [(k // 2, "same" if k % 3 else "text " * (k % 50)) for k in range(count)] + [(None, None)]
    found = run(spark, rows, n, bucket_bytes=bucket)
    assert Counter((r["record"]["doc_id"], r["record"]["text"]) for r in found) == Counter(rows)
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and (len(sizes) == n or len(rows) < n)
    for k in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(sizes[k]))
    assert sorted(r["position"] for r in found) == list(range(len(rows)))


def test_order_is_shuffled_and_follows_the_seed(spark):
    rows = [(k, f"t{k}") for k in range(300)]
    orders = []
    for seed in (1, 2):
        found = sorted(run(spark, rows, 3, seed=seed, bucket_bytes=1 << 20), key=lambda r: r["position"])
        orders.append([r["record"]["doc_id"] for r in found])
    assert orders[0] != orders[1] and orders[0] != sorted(orders[0])
    ups = sum(a < b for a, b in zip(orders[0], orders[0][1:], strict=False))
    assert 110 < ups < 190


def test_order_does_not_follow_the_layout(spark):
    rows = [(k if k % 3 else None, f"t{k}", "p") for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, position string")
    found = []
    for parts in (1, 7):
        path = common.new_path(spark, "shards")
        shards.shard(frame.repartition(parts), 5, path, bucket_bytes=2000)
        back = spark.read.schema("record struct<doc_id: long, text: string>, slot long, shard int").parquet(path)
        found.append(sorted((r["record"]["text"], r["shard"], r["slot"]) for r in back.collect()))
    assert found[0] == found[1]


def test_null_and_repeated_ids_do_not_fill_a_bucket(spark):
    rows = [((None, 5, k)[k % 3], f"text {k}") for k in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select(F.struct("*").alias("record"))
    sizes = [r["count"] for r in frame.groupBy(shards._bucket(10, 1)).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 400


def test_no_rows(spark):
    assert run(spark, [(1, "x")], 2) and not [
        r for r in run(spark, [(1, "x")], 2) if r["record"]["doc_id"] != 1
    ]
    path = common.new_path(spark, "shards")
    shards.shard(spark.createDataFrame([], "doc_id long, text string"), 24, path)
    schema = "record struct<doc_id: long, text: string>, slot long, shard int"
    assert spark.read.schema(schema).parquet(path).count() == 0
