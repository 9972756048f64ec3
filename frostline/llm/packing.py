"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only lengths matter for the plan, and there are at most `size` of them, so the
plan is made from the number of pieces of each length, whatever the size of the
table. Working down the lengths, it consumes single, pair and triple sums of
other lengths that exactly fill the gap, as often as the counts allow; what is
left goes best-fit into the tightest open gap. The plan is a list of patterns
(lengths in one sequence) with multiplicities. A piece finds its place by its
rank among the pieces of its length: ranks are dealt per task while tokenizing
and shifted by the counts of the tasks before, so a length that a third of all
documents share needs no group of its own.

Edge cases: a null or empty text has only the end id; a text of more than `size`
tokens is cut into pieces of which only the first may be shorter; equal rows are
packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.llm import common
from frostline.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length int, ids binary, ids_crc32 long, part int, rank long"
# the more text at once, the fewer distinct pieces to look up for its size
TOKENIZED_BYTES = 8 << 20
RANGES = "length int, low long, high long, sequence_base long, offset long"


def cut(tokens: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    if tokens <= size:
        return [(0, tokens)]
    rest = tokens % size
    return ([(0, rest)] if rest else []) + [(at, size) for at in range(rest, tokens, size)]


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used. Every piece is in exactly one."""
    have = np.zeros(size + 1, np.int64)
    for length, count in counts.items():
        have[length] = count
    patterns: Counter[tuple[int, ...]] = Counter()

    def use(*lengths: int) -> None:
        need = Counter(lengths)
        times = min(int(have[k]) // n for k, n in need.items())
        if times:
            patterns[lengths] += times
            for k, n in need.items():
                have[k] -= n * times

    for length in range(size, 0, -1):
        gap = size - length
        if have[length] and gap == 0:
            use(length)
        if have[length] and gap:
            use(length, gap)
        if have[length]:
            # pair sums: both parts available, the larger first
            some = np.arange(gap - 1, (gap - 1) // 2, -1)
            for a in some[(have[some] > 0) & (have[gap - some] > 0)].tolist():
                use(length, a, gap - a)
                if not have[length]:
                    break
        if have[length]:
            for a in np.flatnonzero(have[:gap])[::-1].tolist():
                if not have[length] or 3 * a < gap:
                    break
                rest = gap - a
                some = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
                for b in some[(have[some] > 0) & (have[rest - some] > 0)].tolist():
                    use(length, a, b, rest - b)
                    if not have[length]:
                        break
    open_bins: dict[int, Counter[tuple[int, ...]]] = defaultdict(Counter)
    for length in range(size, 0, -1):
        left = int(have[length])
        while left:
            gap = min((g for g, bins in open_bins.items() if g >= length and bins), default=None)
            if gap is None:
                per_bin = size // length
                full, rest = divmod(left, per_bin)
                for times, bins in ((per_bin, full), (rest, 1)):
                    if times and bins:
                        open_bins[size - times * length][(length,) * times] += bins
                break
            pattern, bins = open_bins[gap].popitem()
            times = min(left, bins)
            if bins > times:
                open_bins[gap][pattern] = bins - times
            open_bins[gap - length][(*pattern, length)] += times
            left -= times
    for bins in open_bins.values():
        patterns.update(bins)
    return [(k, n) for k, n in patterns.items() if n]


def ranges(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Which ranks of a length go where: (length, low, high, sequence_base,
    offset), the sequence being sequence_base + rank - low."""
    used, out, base = Counter(), [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            out.append((length, used[length], used[length] + times, base, offset))
            used[length] += times
            offset += length
        base += times
    return out


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    tokenizer, part, seen = encoder(vocabulary, end_id), TaskContext.get().partitionId(), Counter()
    for block in common.wide_blocks(batches, TOKENIZED_BYTES):
        rows = defaultdict(list)
        encoded = tokenizer.encode(block.column("text").to_pylist())
        for doc_id, ids in zip(block.column("doc_id").to_pylist(), encoded, strict=True):
            for piece, (start, length) in enumerate(cut(len(ids) // 4, size)):
                own = np.frombuffer(ids, "<u4", length, 4 * start)
                crc = zlib.crc32(own)
                row = (doc_id, piece, start, length, own.astype("<u2").tobytes(), crc, part, seen[length])
                for k, v in zip(_ARROW.names, row, strict=True):
                    rows[k].append(v)
                seen[length] += 1
        yield pa.RecordBatch.from_pydict(rows, schema=_ARROW)


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int32()),
        ("ids", pa.binary()),
        ("ids_crc32", pa.int64()),
        ("part", pa.int32()),
        ("rank", pa.int64()),
    ]
)


def pack(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (16-bit
    little-endian), ids_crc32 (of the ids as 32-bit numbers), sequence_id,
    offset. The vocabulary must have at most 65,536 ids.

    The texts are read once; pieces are written and read back, so ranks stand
    fast. To the driver goes one count per length, back come the ranges. Their
    number depends on `size`, not on the rows: a step of the plan ends a length
    or moves on to the next combination of lengths.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    tokenize = functools.partial(_pieces, vocabulary=vocabulary, end_id=end_id, size=size)
    pieces = common.written(
        docs.select("doc_id", "text").mapInArrow(tokenize, PIECES), "pieces", compression="zstd"
    )
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = common.written(
        counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "lengths"
    )
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length = defaultdict(list)
    for length, *place in ranges(plan(total, size)):
        by_length[length].append(tuple(place))
    schema = T.StructType(
        [
            T.StructField("length", T.IntegerType()),
            T.StructField("places", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("low", "high", "base", "offset")]))),
        ]
    )
    places = spark.createDataFrame([(k, v) for k, v in by_length.items()], schema)
    rank = F.col("rank") + F.col("before")
    placed = (
        pieces.join(counts.select("part", "length", "before"), ["part", "length"])
        .join(F.broadcast(places), "length")
        .withColumn("rank", rank)
        .withColumn(
            "place",
            F.expr("element_at(filter(places, p -> p.low <= rank AND rank < p.high), 1)"),
        )
    )
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids",
        "ids_crc32",
        (F.col("place.base") + F.col("rank") - F.col("place.low")).alias("sequence_id"),
        F.col("place.offset").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences: sequence_id, n_tokens, ids (16-bit little-endian). A
    sequence holds at most `size` tokens, so a group is bounded."""
    row = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), row.alias("rows"))
    joined = F.aggregate("rows", F.lit(b""), lambda whole, x: F.concat(whole, x["ids"]))
    return grouped.select("sequence_id", "n_tokens", joined.alias("ids"))

