"""The audit against every order played out in plain Python."""

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from frostline.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    words = WORD.findall(text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def brute(docs, labels):
    rows = []
    texts = [(d, t or "", lang or "") for d, t, lang in docs]
    for doc, text, part in texts:
        own = fails(text)
        own["E"] = doc is not None and any(d is not None and d < doc and t == text for d, t, _ in texts)
        known = [x for x in labels if x[0] is not None and x[0] == doc]
        rows.append((part, own, any(q == 1 for _, q, _ in known), any(t == 1 for _, _, t in known)))
    out, shapley = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = here
            for step, name in enumerate(order, 1):
                gone = [r for r in left if r[1][name]]
                kept = [r for r in left if not r[1][name]]
                out[part, "".join(order), step] = [
                    len(kept),
                    len(gone),
                    sum(r[1][name] for r in here) - len(gone),
                    sum(r[1][name] and sum(r[1].values()) == 1 for r in here),
                    sum(r[2] for r in gone),
                    sum(r[3] for r in gone),
                ]
                shapley[part, name] += len(gone)
                left = kept
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def random_docs(seed, rows):
    rng, docs = random.Random(seed), []
    for k in range(rows):
        kind = rng.random()
        words = [rng.choice(["ab", "é😀", "Xy", "Q"]) + (str(j) if rng.random() < rng.choice([0.5, 1.0]) else "") for j in range(rng.choice([3, 99, 100, 101, 180]))]
        text = rng.choice([" ", "\n", "\x0b\t"]).join(words) + rng.choice(["", "", " #", "\xa0|"])
        if kind < 0.15 and docs:
            text = rng.choice(docs)[1]
        doc = None if kind > 0.95 else rng.randrange(rows) if kind > 0.85 else k
        docs.append((doc, rng.choice([None, "", " \n"]) if 0.5 < kind < 0.56 else text, rng.choice(["en", "de", "", None])))
    labels = [(rng.choice([None, *range(rows)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(rows // 2)]
    return docs, labels


def found(spark, docs, labels):
    # columns with names that the operator uses itself
    frame = spark.createDataFrame([(*x, "p", 9, {"a": 1}) for x in docs], "doc_id long, text string, lang string, part string, mask int, key map<string, int>")
    known = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, good int")
    return sorted(tuple(r) for r in filter_audit.audit(frame.repartition(3), known).collect())


@pytest.mark.parametrize(("seed", "rows"), [(1, 60), (2, 250)])
def test_against_all_orders(spark, seed, rows):
    docs, labels = random_docs(seed, rows)
    assert found(spark, docs, labels) == brute(docs, labels)


def test_repeated_rows_nulls_and_a_very_long_text(spark):
    long = " ".join(f"wort{k}" for k in range(60000))
    docs = [(3, "A b", "en")] * 3 + [(2, "A b", "de"), (None, "A b", "en"), (None, None, None), (7, None, None), (5, "", "")]
    docs += [(8, long, "en"), (9, long, "en"), (9, long + " x", "de")]
    labels = [(3, 1, 0), (3, 0, 1), (9, 1, None), (None, 1, 1)]
    assert found(spark, docs, labels) == brute(docs, labels)
    assert found(spark, docs, []) == brute(docs, [])
    assert found(spark, [], labels) == []


def test_potentials_give_the_shapley_value(spark):
    """On any game with an empty coalition of 0, against the mean over orders."""
    rng = random.Random(4)
    game = [0, *(rng.randrange(1000) for _ in range(31))]
    row = spark.createDataFrame([(game,)], "game array<long>").select(filter_audit.potentials(F.col("game")).alias("p")).first()["p"]
    for place in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << x for x in order[: order.index(place)])
            total += game[before | 1 << place] - game[before]
        assert row[31] - row[31 - (1 << place)] == total


def test_a_text_in_every_row_meets_only_as_cells(spark):
    """Copies are combined before they are brought together."""
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(docs, labels).filter("filter_order = 'EABCD' and step <= 2").orderBy("step").collect()
    assert [(r["kept"], r["removed"]) for r in rows] == [(1, 19999), (0, 1)]
