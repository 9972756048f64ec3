"""Shuffled shards by a two-pass external shuffle.

Pass one scatters the records by a seeded hash of doc_id and text into buckets of
a size that fits in a task's memory, one bucket a task. Pass two puts every bucket
in an order of its own, whatever order the rows arrived in, shuffles it by Spark's
`shuffle` (the Fisher-Yates algorithm, seeded) and writes it. The result follows
from the rows and the seed alone. The buckets in their order are the
shuffled table; the row counts of the buckets before it tell a bucket its first
position. Shard s of n takes an equal run of positions, so row counts of shards
are at most one apart (the law `rows`).

Everything is DataFrame functions. Memory per task is one bucket; their number
follows from the table's bytes, so it holds at any size. Equal texts scatter by
their ids, rows of a null or repeated id by their texts.

Edge cases: a null text has no bytes and the checksum of an empty text; rows that
repeat doc_id and text share a bucket and get slots of their own; fewer rows than shards leave some
shards empty; an empty table gives no rows. A clashing column name of the input
is not touched, as records ride in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm import common

BUCKET_BYTES = 32 << 20
SEED = 7919


def _bucket(buckets: int, seed: int) -> Column:
    return F.pmod(_draw(seed), F.lit(buckets)).cast("int")


def _draw(seed: int) -> Column:
    return F.xxhash64(F.col("record.doc_id"), F.col("record.text"), F.lit(seed))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shard(docs: DataFrame, shards: int, path: str, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> None:
    """Write record (all columns of docs), position, shard and slot as Parquet to
    `path`, in a folder per shard."""
    records = docs.select(F.struct("*").alias("record"))
    sizes = docs.agg(F.count("*").alias("rows"), F.sum(size_of(F.col("text"))).alias("bytes")).first()
    rows, buckets = sizes["rows"], max(1, -(-(sizes["bytes"] or 0) // bucket_bytes))
    counts = docs.select(F.struct("doc_id", "text").alias("record")).groupBy(_bucket(buckets, seed).alias("bucket")).count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = common.written(
        counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")), "buckets"
    )
    scattered = records.withColumns({"bucket": _bucket(buckets, seed), "key": _draw(seed + 1)})
    scattered = scattered.repartitionById(buckets, "bucket")
    gathered = scattered.groupBy("bucket").agg(F.collect_list(F.struct("key", "record")).alias("keyed"))
    in_order = F.array_sort("keyed", lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    gathered = gathered.withColumn("records", F.transform(in_order, lambda x: x["record"]))
    shuffled = gathered.join(first, "bucket").select(
        "first", F.posexplode(F.shuffle("records", F.lit(seed))).alias("place", "record")
    )
    position = F.col("first") + F.col("place")
    number = F.expr(f"(first + place) * {shards} div {max(1, rows)}").cast("int")
    own = shuffled.select("record", position.alias("position"), number.alias("shard"))
    # the first position of shard s is the least p with p * shards div rows = s
    slot = F.expr(f"position - (cast(shard as bigint) * {rows} + {shards - 1}) div {shards}")
    own.withColumn("slot", slot).write.partitionBy("shard").parquet(path)
