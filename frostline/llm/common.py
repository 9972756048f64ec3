"""Shared pieces: written tables, bounded blocks of text, word and shingle hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir.
    A local master without the setting gets a folder of its own (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="frostline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: a lost executor costs a
    re-read of files, not a recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.frostline_path = path
    return found


def written_in_turns(turns: Iterator[DataFrame], label: str) -> DataFrame:
    """Tables of one schema as one written table. The shuffle files of a turn can
    go before the next one begins."""
    path = None
    for turn in turns:
        path = path or new_path(turn.sparkSession, label)
        turn.write.mode("append").parquet(path)
        release(turn)
    found = turn.sparkSession.read.schema(turn.schema).parquet(path)
    found.frostline_path = path
    return found


def drop(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.frostline_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables, and let Spark drop the shuffle files of plans that are gone:
    it does so when the driver collects its garbage, which may be long after a
    large step."""
    drop(*tables)
    for table in tables[:1]:
        release(table)


def release(table: DataFrame) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to."""
    gc.collect()
    table.sparkSession.sparkContext._jvm.System.gc()


def bounded(rows: DataFrame, limit: int, *by: str) -> DataFrame:
    """A written sample with at most twice `limit` rows. A sample that was taken
    by id has more where ids repeat; then the `limit` rows with the lowest hashes
    of `by` stay."""
    sample = written(rows, "sample")
    if sample.count() <= 2 * limit:
        return sample
    fewer = written(sample.orderBy(F.xxhash64(*by), *by).limit(limit), "sample")
    discard(sample)
    return fewer


def bounded_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's default of 10,000, which long
    texts would make too large for a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each. A longer text is
    a slice of its own; none is cut."""
    _, starts, ends = text_bytes(batch.column(column))
    before = np.concatenate(([0], np.cumsum(ends - starts)))
    row, rows = 0, batch.num_rows
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(before, before[row] + limit, "right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop


def wide_blocks(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Blocks of `text_blocks` over batches that were put together, up to `limit`
    bytes or one batch."""

    def blocks(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in pa.Table.from_batches(some).combine_chunks().to_batches():
            yield from text_blocks(whole, column, limit)

    waiting, size = [], 0
    for batch in batches:
        if waiting and size + batch.column(column).nbytes > limit:
            yield from blocks(waiting)
            waiting, size = [], 0
        waiting.append(batch)
        size += batch.column(column).nbytes
    if waiting:
        yield from blocks(waiting)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and where each text starts and ends in
    them. Null counts as empty."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    size = len(column)
    if size == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + size + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    starts, ends = at[:-1] - at[0], at[1:] - at[0]
    if column.null_count:
        ends = np.where(np.asarray(column.is_valid()), ends, starts)
    return raw, starts, ends


_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a block of texts.

    `is_word` tells by byte value what belongs to a word, after `fold` was
    applied to every byte. In UTF-8 every byte beyond ASCII is 128 or more, so
    classes of ASCII characters are classes of bytes. `starts` and `ends` are
    byte places of words, `first` and `last` the words of each text.
    """

    def __init__(self, column: pa.Array, is_word: np.ndarray, fold: np.ndarray):
        raw, starts, ends = text_bytes(column)
        self.raw = fold[raw]
        inside = is_word[self.raw]
        follows = np.zeros(len(inside) + 1, bool)
        follows[1:] = inside
        follows[starts] = False
        goes_on = np.zeros(len(inside) + 1, bool)
        goes_on[:-1] = inside
        goes_on[starts] = False
        self.starts = np.flatnonzero(inside & ~follows[:-1])
        self.ends = np.flatnonzero(inside & ~goes_on[1:]) + 1
        self.first = np.searchsorted(self.starts, starts)
        self.last = np.searchsorted(self.starts, ends)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        size = len(self.raw)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        power = np.full(size, _ODD, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        del power
        back = np.full(size, _ODD_INVERSE, np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        own = (sums[self.ends] - sums[self.starts]) * back[self.starts]
        return mixed(own + (self.ends - self.starts).astype(np.uint64))


_PLACES = (0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7, 0xF1357AEA2E62A9C5, 0x9FB21C651E98DF25)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` (up to 5) consecutive word hashes."""
    count = max(0, len(words) - size + 1)
    total = np.full(count, size, np.uint64)
    for place in range(size):
        total += words[place : place + count] * np.uint64(_PLACES[place])
    return mixed(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
