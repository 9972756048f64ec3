"""Hit words and items against a search of every window."""

import random
import re

import pytest

from frostline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        for at in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[at : at + size]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if own := windows.get(tuple(w[at : at + n])):
                    hit.update(range(at, at + n))
                    found |= own
        out[doc] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("limit", [1000, 3])
def test_against_every_window(spark, limit):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["A", "b", "Ç3", "d-e"]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 60))) for k in range(150)] + [(200, None), (201, ""), (202, text(30000))]
    items = [(k, text(n)) for k, n in enumerate([0, 1, 2, 3, 4, 5, 6, 12, 12])] + [(9, None), (10, "--")]
    items += [(11, items[-3][1])]
    frame = spark.createDataFrame([(*x, 7) for x in docs], "doc_id long, text string, n_hit long").repartition(3)
    found = decontaminate.find_items(frame, spark.createDataFrame(items, "item_id long, text string"), 5, limit).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in found} == brute(docs, items, 5)
    assert len(found) == len(docs)


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.find_items(docs, none).collect()] == [(1, "a b c", 3, 0, [], [])]
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.find_items(docs.limit(0), items).count() == 0
