"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on
windows of one to `RUN_WORDS` words of toxic text. Every such window may be drawn,
in proportion to the number of its different contexts in toxic documents times a
power of its contrast, that is how much more often it has a context there than in
ordinary documents (contexts, as copies of one document would otherwise make its
rare words look typical). A window of a text is
compressed with the ordinary dictionary, and with the ordinary one after the toxic
one; as both share the ordinary part, the lengths differ only by what the toxic
part saves. A text's largest saving, the sum of its savings and the numbers of
windows above two thresholds are calibrated to a probability by logistic
regression on the labelled documents.

Learning reads at most about `TRAIN_ROWS` labelled documents of each class, taken
by a hash of doc_id. The driver gets bounded samples only: about `TOXIC_WINDOWS`
and `ORDINARY_WINDOWS` windows, and the five figures of each training document.
Scoring reads every whole text once and shuffles nothing.

Edge cases: a null or empty text has no windows and gets the calibrated score of
none; without toxic or without ordinary labels, every score is 0; an id with labels
of both kinds teaches nothing; rows are scored one by one, so copies score alike;
texts of any length are scored whole; an empty table gives no rows. `score` carries
all columns and replaces one named `score`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm import common
from frostline.llm.rows import partial_rows, with_texts

# from this score on a document is toxic, here and in the pipeline
TOXIC_FROM = 0.3
TRAIN_ROWS = 6_000
ORDINARY_WINDOWS = 20_000
TOXIC_WINDOWS = 20_000
RUN_WORDS = 3
CONTRAST_POWER = 1.5
WINDOW_WORDS = 6
SAMPLE_WORDS = 40
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 8 << 10
LEVEL = 12

_IS_WORD = np.array([not (x in b" .," or 9 <= x <= 13) for x in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)

FIGURES = "largest long, total long, over_two long, over_three long, windows long"


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; no dictionaries, no toxic text."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = ()


def _words(text: str | None) -> list[str]:
    return text.lower().replace(".", " ").replace(",", " ").split() if text else []


def windows(text: str | None) -> list[bytes]:
    words = _words(text)
    return [
        f" {' '.join(words[at : at + WINDOW_WORDS])} ".encode("utf-8", "surrogatepass")
        for at in range(0, len(words), WINDOW_WORDS)
    ]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def _savings(model: Model):
    """From texts to their figures."""
    plain = _compressor(model.ordinary).compress
    marked = _compressor(model.toxic + model.ordinary).compress

    def of(text: str | None) -> tuple[int, int, int, int, int]:
        saved = [len(plain(x)) - len(marked(x)) for x in windows(text)]
        some = [x for x in saved if x > 0]
        return max(some, default=0), sum(some), sum(x >= 2 for x in some), sum(x >= 3 for x in some), len(saved)

    return of


def _inputs(figures: np.ndarray) -> np.ndarray:
    largest, rest = figures[:, :1], np.log1p(figures[:, 1:])
    return np.concatenate([np.ones_like(largest), largest, rest], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    beta, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ beta
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _trained(samples: list[str], size: int) -> bytes:
    """A trained dictionary's bytes; too few samples are their own dictionary."""
    raw = [x.encode("utf-8", "surrogatepass") for x in samples]
    try:
        return zstandard.train_dictionary(size, raw).as_bytes()
    except zstandard.ZstdError:
        return b"".join(raw)[-size:]


def _runs(texts: pa.Array):
    """For each length up to `RUN_WORDS`: hashes of the runs of words, hashes of
    them with the word before, and the bytes where they start and end."""
    words = common.Words(texts, _IS_WORD, _FOLD)
    hashes = words.hashes()
    text_of = np.repeat(np.arange(len(words.first)), words.last - words.first)
    before = np.zeros(len(hashes), np.uint64)
    before[1:] = np.where(text_of[1:] == text_of[:-1], hashes[:-1], np.uint64(0))
    for size in range(1, min(RUN_WORDS, len(hashes)) + 1):
        count = len(hashes) - size + 1
        own = text_of[size - 1 :] == text_of[:count]
        runs = common.shingle_hashes(hashes, size)[own]
        seen = common.mixed(runs + common.mixed(before[:count][own] + np.uint64(1)))
        yield words, common.signed(runs), common.signed(seen), words.starts[:count][own], words.ends[size - 1 :][own]


def _contexts(batches):
    for batch in batches:
        for block in common.text_blocks(batch):
            for toxic in (0, 1):
                texts = block.column("text").filter(pc.equal(block.column("toxic"), toxic))
                for _, runs, seen, _, _ in _runs(texts):
                    seen, at = np.unique(seen, return_index=True)
                    kinds = pa.array(np.full(len(at), toxic, np.int32))
                    yield pa.RecordBatch.from_arrays([kinds, pa.array(runs[at]), pa.array(seen)], names=["toxic", "run", "seen"])


def _named(wanted: np.ndarray):
    def run(batches):
        for batch in batches:
            for block in common.text_blocks(batch):
                for words, runs, _, starts, ends in _runs(block.column("text")):
                    own, at = np.unique(runs, return_index=True)
                    at = at[np.isin(own, wanted)]
                    cut = [words.raw[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(starts[at], ends[at], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(runs[at]), pa.array([" ".join(_words(x)) for x in cut], pa.string())], names=["run", "said"]
                    )

    return run


def _marks(rows: DataFrame, per_class: dict[int, int]) -> list[tuple[str, int]]:
    """Windows of one to `RUN_WORDS` words of toxic documents, each with how often
    it is drawn. A window of little weight is drawn by a hash, once or not."""
    low = rows.select("toxic", F.lower("text").alias("text"))
    seen = partial_rows(low, ["toxic", "text"], "toxic int, run long, seen long", _contexts).distinct()
    toxic, ordinary = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    counted = seen.groupBy("run").agg(toxic.alias("toxic"), ordinary.alias("ordinary")).filter("toxic > 0")
    contrast = (F.col("toxic") + 1) / per_class[1] / ((F.col("ordinary") + 1) / per_class[0])
    weight = F.col("toxic") * F.pow(contrast, F.lit(CONTRAST_POWER))
    weighed = common.written(counted.select("run", weight.alias("weight")), "marks")
    total = weighed.agg(F.sum("weight").alias("total")).first()["total"]
    if not total:
        return []
    chance = F.pmod(F.xxhash64("run"), F.lit(1_000_000)) / 1_000_000
    times = F.floor(F.col("weight") * (TOXIC_WINDOWS / total) + chance)
    drawn = {r["run"]: r["n"] for r in weighed.select("run", times.alias("n")).filter("n > 0").collect()}
    named = partial_rows(low.filter("toxic = 1"), ["text"], "run long, said string", _named(np.array(sorted(drawn), np.int64)))
    # the smallest of the texts of one run, which differ by what is between words
    named = named.groupBy("run").agg(F.min("said").alias("said")).collect()
    common.discard(weighed)
    return sorted((r["said"], drawn[r["run"]]) for r in named)


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (rows that may be learned from)."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    # an id with labels of both kinds teaches nothing
    known = known.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("other"))
    known = known.filter("toxic = other").select("doc_id", "toxic")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model()
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = {k: min(1.0, train_rows / n) for k, n in sizes.items()}
    limit = F.when(F.col("toxic") == 1, int(1_000_000 * share[1])).otherwise(int(1_000_000 * share[0]))
    # bounded by train_rows of each class
    picked = F.broadcast(known.filter(order < limit))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).join(picked, "doc_id")
    rows = common.bounded(rows.select("doc_id", "text", "toxic"), 2 * train_rows, "doc_id", "text", "toxic")
    low = F.translate(F.lower("text"), ".,", "  ")
    words = rows.select("toxic", "doc_id", F.split(F.trim(low), r"\s+").alias("words"))
    per_class = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not per_class.get(0) or not per_class.get(1):
        return Model()
    marks = _marks(rows, per_class)
    if not marks:
        return Model()
    starts = F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)), F.lit(SAMPLE_WORDS))
    sampled = words.filter("toxic = 0").select(
        "doc_id", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, SAMPLE_WORDS), " ")))
    )
    sampled = sampled.select("col").distinct()
    part = min(1.0, ORDINARY_WINDOWS / max(1, sampled.count()))
    sampled = sampled.filter(F.pmod(F.xxhash64("col"), F.lit(1_000_000)) < int(1_000_000 * part))
    ordinary = _trained(sorted(f" {r['col']} " for r in sampled.collect()), ORDINARY_BYTES)
    said = [w for w, n in marks for _ in range(n)]
    mixed = [said[i] for i in np.random.default_rng(1).permutation(len(said))]
    toxic = _trained([f" {' '.join(mixed[i : i + 8])} " for i in range(0, len(mixed), 8)], TOXIC_BYTES)
    model = Model(ordinary, toxic)
    found = figures(rows, model, ["toxic"]).collect()
    x = _inputs(np.array([list(r)[1:] for r in found], float))
    y = np.array([r["toxic"] for r in found], float)
    weights = _logistic(x, y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    return Model(ordinary, toxic, tuple(weights.tolist()))


def figures(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    def compute():
        of = _savings(model)

        def run(texts: pa.Array) -> list:
            found = [of(x) for x in texts.to_pylist()]
            return [list(x) for x in zip(*found, strict=True)] if found else [[]] * 5

        return run

    return with_texts(docs, keep, FIGURES, compute)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score`, the calibrated probability of being toxic."""
    keep = [x for x in docs.columns if x != "score"]
    if not model.weights:
        return docs.select(*(F.col(f"`{x}`") for x in keep), F.lit(0.0).alias("score"))

    def compute():
        of, weights = _savings(model), np.array(model.weights)

        def run(texts: pa.Array) -> list:
            found = np.array([of(x) for x in texts.to_pylist()], float).reshape(-1, 5)
            return [1 / (1 + np.exp(-np.clip(_inputs(found) @ weights, -30, 30)))]

        return run

    return with_texts(docs, keep, "score double", compute)
