"""The plan's properties, and the packed pieces against the library's ids."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_tokens import library_ids

from frostline.llm import packing


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 20, 64])
    counts = {k: rng.randint(0, 40) for k in range(1, size + 1) if rng.random() < 0.7}
    patterns = packing.plan(counts, size)
    used = Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= size and times > 0
        for x in lengths:
            used[x] += times
    assert used == Counter({k: n for k, n in counts.items() if n})
    bins, tokens = sum(n for _, n in patterns), sum(k * n for k, n in counts.items())
    assert bins <= 1.15 * tokens / size + 2
    ranges = packing.ranges(patterns)
    for length, n in counts.items():
        spans = sorted((low, high) for x, low, high, _, _ in ranges if x == length)
        assert [a for a, _ in spans] == [0, *(b for _, b in spans)][: len(spans)] and (not n or spans[-1][1] == n)


def test_exact_complements_fill_sequences():
    assert sum(n for _, n in packing.plan({6: 5, 4: 5}, 10)) == 5
    assert sum(n for _, n in packing.plan({5: 4, 3: 4, 2: 4}, 10)) == 4
    assert sum(n for _, n in packing.plan({4: 2, 3: 2, 2: 2, 1: 2}, 10)) == 2


@pytest.mark.parametrize("tokens", [1, 9, 10, 11, 20, 25])
def test_only_the_first_piece_is_short(tokens):
    pieces = packing.cut(tokens, 10)
    assert [a for a, _ in pieces] == np.cumsum([0, *(n for _, n in pieces)])[:-1].tolist()
    assert sum(n for _, n in pieces) == tokens and all(n == 10 for _, n in pieces[1:])


def test_pieces_lie_gapless_in_sequences(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "Löwe", "x,", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    rows = [(k, x, k) for k, x in enumerate([*texts, *["same text"] * 60, None, ""])] + [(None, "without id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank long").repartition(4)
    packed = packing.pack(docs, "byte_bpe_50k.json", 0, 16)
    found = packed.collect()
    ids = dict(zip((x[0] for x in rows), library_ids("byte_bpe_50k.json", 0, [x[1] for x in rows]), strict=True))
    assert sum(r["length"] for r in found) == sum(map(len, ids.values()))
    by_sequence = {}
    for r in found:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert np.frombuffer(r["ids"], "<u2").tolist() == own
        assert r["ids_crc32"] == zlib.crc32(np.asarray(own, "<u4").tobytes())
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        places.sort()
        assert [a for a, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist()
        assert sum(n for _, n in places) <= 16
    assert len(by_sequence) <= 1.03 * sum(map(len, ids.values())) / 16 + 1
    whole = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in whole) == 2 * sum(map(len, ids.values()))
    assert all(len(r["ids"]) == 2 * r["n_tokens"] for r in whole)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, "byte_bpe_50k.json", 0, 16).count() == 0
