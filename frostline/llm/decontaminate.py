"""Benchmark decontamination as a prefix-filtered set join.

Every item gives its windows of `window` consecutive words, a shorter item one
window of all its words. A window is a set of shingles with places. The join asks
for whole containment, so of each window's shingles, ordered by how rare they are
in the documents, a prefix of one is enough: a document that holds the window
holds its rarest shingle. A first pass counts the items' shingles in all
documents. The second looks up the rarest shingles, places the window around each
match, drops those that would begin before or end after the document (length and
place bounds), and compares all words of the rest exactly.

Benchmark windows go to the executors in blocks of at most `BLOCK_WINDOWS`, so a
broadcast is bounded whatever the benchmark's size. Documents stay where they are:
a pass is narrow, only counts of the block's shingles are shuffled.

Edge cases: a null or empty text has no words and no hits; an item without words
has no windows; windows that several items share count for each; repeated rows
are judged one by one; an empty benchmark leaves everything clean.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm import common
from frostline.llm.rows import partial_rows, with_texts

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 100_000

_IS_WORD = np.array([x >= 128 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A for x in range(256)])
_FOLD = np.array([x + 32 if 0x41 <= x <= 0x5A else x for x in range(256)], np.uint8)
_ITEM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FLAG_BITS = 20


def item_words(text: str | None) -> list[bytes]:
    return _ITEM_WORD.findall((text or "").encode().lower())


class Index:
    """A block of benchmark windows: their words, shingles and items."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        self.texts = [b" ".join(x) for x in windows]
        self.items = [sorted(x) for x in windows.values()]
        self.sizes = np.array([len(x) for x in windows], np.int64)
        words = [w for x in windows for w in x]
        hashes = common.Words(pa.array([w.decode() for w in words], pa.string()), _IS_WORD, _FOLD).hashes()
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.words = hashes
        self.rarest: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def shingles(self) -> dict[int, np.ndarray]:
        """By size, all distinct shingles."""
        found: dict[int, list[np.ndarray]] = {}
        for at, size in zip(self.first, self.sizes, strict=True):
            own = min(SHINGLE, size)
            found.setdefault(int(own), []).append(common.shingle_hashes(self.words[at : at + size], int(own)))
        return {k: np.unique(np.concatenate(v)) for k, v in found.items()}

    def order_by_rarity(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep of each window its rarest shingle and that one's place. Windows
        with a shingle that no document holds occur nowhere."""
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for number, (at, size) in enumerate(zip(self.first, self.sizes, strict=True)):
            own = int(min(SHINGLE, size))
            hashes = common.shingle_hashes(self.words[at : at + size], own).tolist()
            count, key, place = min((counts.get((own, h), 0), h, i) for i, h in enumerate(hashes))
            if count:
                rows.setdefault(own, []).append((key, number, place))
        for own, found in rows.items():
            found.sort()
            self.rarest[own] = (
                np.array([x[0] for x in found], np.uint64),
                np.array([x[1] for x in found], np.int64),
                np.array([x[2] for x in found], np.int64),
            )


class Matcher:
    """Finds a sorted set of hashes among many; a table of flags on the top bits
    turns most away."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, np.uint64(64 - _FLAG_BITS)
        self.flags = np.zeros(1 << _FLAG_BITS, bool)
        self.flags[keys >> self.shift] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in `hashes` that match, with the bounds of equal keys."""
        some = np.flatnonzero(self.flags[hashes >> self.shift])
        low = np.searchsorted(self.keys, hashes[some], "left")
        high = np.searchsorted(self.keys, hashes[some], "right")
        hit = high > low
        return some[hit], low[hit], high[hit]


def _count_shingles(shingles: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = {size: Matcher(keys) for size, keys in shingles.items()}
        totals = {size: np.zeros(len(keys), np.int64) for size, keys in shingles.items()}
        for batch in batches:
            for block in common.text_blocks(batch):
                words = common.Words(block.column("text"), _IS_WORD, _FOLD)
                hashes, ends = words.hashes(), words.last
                for size in shingles:
                    places, low, _ = match[size](common.shingle_hashes(hashes, size))
                    inside = places + size <= ends[np.searchsorted(ends, places, "right")]
                    np.add.at(totals[size], low[inside], 1)
        for size, total in totals.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict(
                {
                    "size": pa.array([size] * len(some), pa.int32()),
                    "shingle": common.signed(shingles[size][some]),
                    "n": total[some],
                }
            )

    return run


def _join_intervals(old: list[int] | None, new: list[tuple[int, int]]) -> list[int]:
    """Disjoint intervals, flat: start, end, start, end ..."""
    spans = sorted([*zip((old or [])[::2], (old or [])[1::2], strict=True), *new])
    flat: list[int] = []
    for start, end in spans:
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [start, end]
    return flat


def _find(index: Index):
    """From texts to (n_words, hit intervals in words, items)."""

    def compute():
        match = {size: Matcher(keys) for size, (keys, _, _) in index.rarest.items()}

        def of(texts: pa.Array) -> list:
            words = common.Words(texts, _IS_WORD, _FOLD)
            hashes, ends = words.hashes(), words.last
            spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
            items: list[set[str]] = [set() for _ in range(len(texts))]
            for size, (_, windows, offsets) in index.rarest.items():
                places, low, high = match[size](common.shingle_hashes(hashes, size))
                if not len(places):
                    continue
                times = high - low
                entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
                doc = np.repeat(np.searchsorted(ends, places, "right"), times)
                number = windows[entry]
                start = np.repeat(places, times) - offsets[entry]
                long = index.sizes[number]
                fits = (start >= words.first[doc]) & (start + long <= ends[doc])
                doc, number, start, long = doc[fits], number[fits], start[fits], long[fits]
                for step in range(int(long.max()) if len(long) else 0):
                    at = np.minimum(start + step, len(hashes) - 1)
                    own = np.minimum(index.first[number] + step, len(index.words) - 1)
                    same = (step >= long) | (hashes[at] == index.words[own])
                    doc, number, start, long = doc[same], number[same], start[same], long[same]
                for d, w, s, n in zip(doc.tolist(), number.tolist(), start.tolist(), long.tolist(), strict=True):
                    found = b" ".join(
                        words.raw[a:b].tobytes() for a, b in zip(words.starts[s : s + n], words.ends[s : s + n], strict=True)
                    )
                    if found == index.texts[w]:
                        spans[d].append((s - int(words.first[d]), s + n - int(words.first[d])))
                        items[d].update(index.items[w])
            return [words.last - words.first, [_join_intervals(None, x) for x in spans], [sorted(x) for x in items]]

        return of

    return compute


def _blocks(benchmark: DataFrame, window: int, limit: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    block: dict[tuple[bytes, ...], set[str]] = {}
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.toLocalIterator():
        words = item_words(row["text"])
        for start in range(max(1, len(words) - window + 1) if words else 0):
            block.setdefault(tuple(words[start : start + window]), set()).add(row["item_id"] or "")
            if len(block) >= limit:
                yield block
                block = {}
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with n_words, n_hit, hit_words (disjoint word intervals, flat: start,
    end, ...), items (sorted as strings)."""
    keep, out = docs.columns, docs
    for number, block in enumerate(_blocks(benchmark, window, limit)):
        index = Index(block)
        shingles = index.shingles()
        counted = partial_rows(
            docs.filter(F.col("text").isNotNull()), ["text"], "size int, shingle long, n long", _count_shingles(shingles)
        )
        counts = Counter()
        for r in counted.groupBy("size", "shingle").agg(F.sum("n").alias("n")).collect():
            counts[(r["size"], r["shingle"] & 0xFFFFFFFFFFFFFFFF)] = r["n"]
        index.order_by_rarity(counts)
        before = [f"frostline_hits_{number}", f"frostline_items_{number}"]
        out = with_texts(out, out.columns, f"n_words long, {before[0]} array<long>, {before[1]} array<string>", _find(index))
    found = [x for x in out.columns if x.startswith("frostline_hits_")]
    if not found:
        index = Index({})
        out = with_texts(out, keep, "n_words long, frostline_hits_0 array<long>, frostline_items_0 array<string>", _find(index))
        found = ["frostline_hits_0"]
    merged = _merged(found)
    items = F.sort_array(F.array_distinct(F.concat(*(x.replace("_hits_", "_items_") for x in found))))
    out = out.withColumns({"hit_words": merged, "items": items})
    signed = F.transform("hit_words", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)
    own = [x for x in keep if x not in ("n_words", "n_hit", "hit_words", "items")]
    return out.select(*(F.col(f"`{x}`") for x in own), "n_words", n_hit.alias("n_hit"), "hit_words", "items")


def _merged(columns: list[str]) -> Column:
    """Disjoint intervals of several blocks as one sorted list."""
    if len(columns) == 1:
        return F.col(columns[0])
    def ends(column: str, odd: int) -> Column:
        return F.filter(column, lambda _, i: i % 2 == odd)

    pairs = F.concat(
        *(
            F.zip_with(ends(x, 0), ends(x, 1), lambda start, stop: F.struct(start.alias("start"), stop.alias("stop")))
            for x in columns
        )
    )
    none = F.expr("cast(array() as array<bigint>)")
    return F.aggregate(
        F.sort_array(pairs),
        none,
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.greatest(F.element_at(done, -1), x["stop"]))),
        ).otherwise(F.concat(done, F.array(x["start"], x["stop"]))),
    )
