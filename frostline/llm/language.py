"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A
letter's vector is rotated by its distance from the end of the n-gram, and the
vectors of an n-gram are multiplied into one. A text's profile is the sum of the
vectors of all its n-grams of lower-case letters, a run of other characters
counting as one boundary sign. A language's prototype is the sum of the scaled
profiles of its documents, and a document gets the language of the highest
cosine.

Prototypes are learned from at most about `train_rows` labelled documents, taken
by a hash of doc_id; they are small integers summed by Spark, so the result does
not depend on the order of rows. Prediction reads every whole text once and
shuffles nothing.

Edge cases: a null text or one without a letter is `und` with score 0; so is
every text where nothing could be learned; equal cosines go to the language that
sorts first; a text of one letter has the n-grams with its boundaries.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.rows import partial_rows, with_texts

DIMENSIONS = 1024
NGRAM = 3
SEED = 20240
TRAIN_ROWS = 20_000
UNKNOWN = "und"
_SCALE = 4096
_PART = 4096


class Profiles:
    """Profiles of texts. Letters get a row in three tables (one per place in
    the n-gram) when first seen."""

    def __init__(self):
        points = range(0x110000)
        self.letter = np.fromiter((chr(x).isalpha() for x in points), bool, len(points))
        self.row = np.full(len(points), -1, np.int64)
        self.tables = np.zeros((NGRAM, 0, DIMENSIONS), np.int8)

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        rows = self.row[codes]
        if (rows < 0).any():
            new = np.unique(codes[rows < 0])
            signs = [np.random.default_rng([SEED, int(x)]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1 for x in new]
            signs = np.stack(signs).astype(np.int8)
            turned = np.stack([np.roll(signs, NGRAM - 1 - place, axis=1) for place in range(NGRAM)])
            self.row[new] = self.tables.shape[1] + np.arange(len(new))
            self.tables = np.concatenate([self.tables, turned], axis=1)
            rows = self.row[codes]
        return rows

    def profile(self, text: str | None) -> np.ndarray | None:
        """The scaled profile, or None where there is no letter."""
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letters = self.letter[codes]
        if not letters.any():
            return None
        codes = np.concatenate(([0], np.where(letters, codes, 0), [0]))
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
        rows = self._rows(codes)
        grams = np.zeros(len(rows) - NGRAM + 1, np.int64)
        for place in range(NGRAM):
            grams = (grams << 21) | rows[place : place + len(grams)]
        grams, counts = np.unique(grams, return_counts=True)
        total = np.zeros(DIMENSIONS, np.float64)
        for at in range(0, len(grams), _PART):
            part = grams[at : at + _PART]
            bound = np.ones((len(part), DIMENSIONS), np.int8)
            for place in range(NGRAM):
                bound *= self.tables[place, (part >> (21 * (NGRAM - 1 - place))) & 0x1FFFFF]
            total += counts[at : at + _PART].astype(np.float32) @ bound.astype(np.float32)
        size = np.sqrt((total * total).sum())
        return total / size if size else None


@functools.cache
def profiles() -> Profiles:
    return Profiles()


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            own = profiles().profile(text)
            if own is not None:
                sums.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
                sums[lang] += np.rint(own * _SCALE).astype(np.int64)
    for lang, total in sums.items():
        yield pa.RecordBatch.from_pydict(
            {"lang": [lang] * DIMENSIONS, "place": pa.array(range(DIMENSIONS), pa.int32()), "value": total}
        )


def learn(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Prototypes by language, from rows (doc_id, text, lang) with a language."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    count = rows.select("doc_id").count()
    if count > train_rows:
        share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
        rows = rows.filter(share < int(1_000_000 * train_rows / count))
    sums = partial_rows(rows, ["text", "lang"], "lang string, place int, value long", _partial_sums)
    found: dict[str, np.ndarray] = {}
    for row in sums.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect():
        found.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["place"]] = row["value"]
    return {k: v / np.sqrt((v * v).sum()) for k, v in sorted(found.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """docs with lang_pred and score (the cosine, 0 at least)."""
    names = list(prototypes)
    matrix = np.stack(list(prototypes.values())) if names else None

    def compute():
        def of(texts: pa.Array) -> list:
            found, scores = [], []
            for text in texts.to_pylist():
                own = profiles().profile(text) if names else None
                if own is None:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    cosines = matrix @ own
                    best = int(np.argmax(cosines))
                    found.append(names[best])
                    scores.append(min(1.0, max(0.0, float(cosines[best]))))
            return [found, scores]

        return of

    keep = [x for x in docs.columns if x != "text"]
    return with_texts(docs, keep, "lang_pred string, score double", compute)
