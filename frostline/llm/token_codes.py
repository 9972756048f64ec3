"""Token ids in files of directly addressable codes.

An id is split into bytes, lowest first. Level 0 holds the lowest byte of every
token, level 1 the second byte of those tokens that have one, and so on. Each
level has a bitmap that says which of its tokens go on in the next level, and a
directory with the number of set bits before every 512th. The place of a token's
byte in the next level is the number of set bits before its own, so any token is
read with a few look-ups and without decoding what stands before it.

A file row is a segment: whole documents in order, closed after about
`SEGMENT_TOKENS` tokens. The files are Parquet written by Spark, so a task that
is lost or run twice leaves nothing behind. Segments are numbered within a part;
parts follow the order of doc_id.

Edge cases: a null text is empty and holds only the end id; rows with a null
doc_id come first; rows of equal doc_id stand next to each other in any order;
an empty table gives no rows; a segment never cuts a document, however long.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm import common
from frostline.llm.tokens import encoder

SEGMENT_TOKENS = 1 << 18
RANK_BITS = 512

SEGMENTS = (
    "part int, segment int, first_token long, n_tokens long, doc_ids array<long>, lengths array<long>, "
    "levels array<struct<bytes: binary, goes_on: binary, ranks: binary>>"
)
_LEVEL = pa.struct([("bytes", pa.binary()), ("goes_on", pa.binary()), ("ranks", pa.binary())])
_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("first_token", pa.int64()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("levels", pa.list_(_LEVEL)),
    ]
)


def split_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of a run of ids."""
    rest, levels = ids.astype(np.uint32), []
    while len(rest) or not levels:
        low = (rest & np.uint32(0xFF)).astype(np.uint8)
        goes_on = rest > 0xFF
        ones = np.concatenate(([0], np.cumsum(goes_on, dtype=np.uint32)[RANK_BITS - 1 :: RANK_BITS]))
        levels.append(
            {
                "bytes": low.tobytes(),
                "goes_on": np.packbits(goes_on, bitorder="little").tobytes(),
                "ranks": ones.astype("<u4").tobytes(),
            }
        )
        rest = rest[goes_on] >> np.uint32(8)
    return levels


def join_levels(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment."""
    low = np.frombuffer(levels[0]["bytes"], np.uint8)
    ids, at = low.astype(np.uint32), np.arange(len(low))
    for depth, level in enumerate(levels[:-1]):
        goes_on = np.unpackbits(np.frombuffer(level["goes_on"], np.uint8), count=len(at), bitorder="little")
        at = at[goes_on.astype(bool)]
        ids[at] |= np.frombuffer(levels[depth + 1]["bytes"], np.uint8).astype(np.uint32) << np.uint32(8 * depth + 8)
    return ids


def token_at(levels: list[dict[str, bytes]], place: int) -> int:
    """One id, from one byte, one bit and one rank per level."""
    value = 0
    for depth, level in enumerate(levels):
        value |= level["bytes"][place] << (8 * depth)
        bits = level["goes_on"]
        if not bits[place >> 3] >> (place & 7) & 1:
            break
        block = place // RANK_BITS
        rank = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
        whole = bits[block * RANK_BITS // 8 : place >> 3]
        rank += int.from_bytes(whole, "little").bit_count()
        place = rank + (bits[place >> 3] & ((1 << (place & 7)) - 1)).bit_count()
    return value


def _segments(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    tokenizer = encoder(vocabulary, end_id)
    part = TaskContext.get().partitionId()
    doc_ids, ids, tokens, segment, first = [], [], 0, 0, 0

    def closed() -> pa.RecordBatch:
        row = {
            "part": part,
            "segment": segment,
            "first_token": first,
            "n_tokens": tokens,
            "doc_ids": doc_ids,
            "lengths": [len(x) // 4 for x in ids],
            "levels": split_levels(np.frombuffer(b"".join(ids), "<u4")),
        }
        return pa.RecordBatch.from_pylist([row], schema=_ARROW)

    for batch in batches:
        for block in common.text_blocks(batch):
            encoded = tokenizer.encode(block.column("text").to_pylist())
            for doc_id, own in zip(block.column("doc_id").to_pylist(), encoded, strict=True):
                doc_ids.append(doc_id)
                ids.append(own)
                tokens += len(own) // 4
                if tokens >= SEGMENT_TOKENS:
                    yield closed()
                    first, segment = first + tokens, segment + 1
                    doc_ids, ids, tokens = [], [], 0
    if doc_ids:
        yield closed()


def write_codes(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encode every text and write the segments to `path`, parts in ascending
    order of doc_id. One shuffle, of the texts, by range."""
    common.bounded_batches(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    encode = functools.partial(_segments, vocabulary=vocabulary, end_id=end_id)
    ordered.mapInArrow(encode, SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = join_levels(row["levels"]).astype("<u4")
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "part": pa.array([row["part"]] * len(ends), pa.int32()),
                    "segment": pa.array([row["segment"]] * len(ends), pa.int32()),
                    "place": pa.array(starts + row["first_token"], pa.int64()),
                    "n_tokens": pa.array(row["lengths"], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                }
            )


def read_segments(spark, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32, part, segment. The tokens before
    each part are summed over one row per part."""
    segments = read_segments(spark, path)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    found = segments.mapInArrow(
        _documents, "doc_id long, part int, segment int, place long, n_tokens long, ids_crc32 long"
    )
    return found.join(parts, "part").select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "part", "segment"
    )
