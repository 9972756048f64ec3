"""Held-out ranking, and texts at the edges."""

import random

from frostline.llm import toxicity

SYLLABLES = ["an", "re", "tho", "li", "mo", "wen", "sta", "ker", "ö", "du"]


def corpus(count, seed):
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    for k in range(count):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic = int(k % 5 == 0)
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["pathetic", "worthless", "disgusting", "clowns"]))
        rows.append((k, " ".join(words).capitalize() + ".", toxic))
    return rows


def test_held_out_documents_rank_right(spark):
    rows = corpus(700, 1)
    docs = spark.createDataFrame([(k, t, 0.5) for k, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels.filter("doc_id < 450"))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(found[k], y) for k, _, y in rows if k >= 450]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    assert sum(a < b for a in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert sum(s >= 0.3 for s in bad) >= 0.85 * len(bad) and sum(s >= 0.3 for s in good) <= 0.05 * len(good)
    odd = [(1, None), (2, ""), (3, " . "), (4, "worthless " * 20000), (4, "worthless " * 20000), (None, "x" * 100000)]
    odd = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert len(odd) == 6 and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in odd if r["doc_id"] == 4}) == 1
    assert next(r["score"] for r in odd if r["doc_id"] == 1) < 0.3
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 0), (2, 0)], [(None, 1), (1, None)], [(1, 0), (2, 1)]):
        model = toxicity.learn(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r["score"] for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]


def test_phrases_of_ordinary_words(spark):
    """No single word tells, as the words of the phrase are as common elsewhere."""
    rng, rows = random.Random(3), []
    vocabulary = sorted({"".join(rng.choice(SYLLABLES) for _ in range(3)) for _ in range(150)})
    phrase = vocabulary[10:14]
    for k in range(500):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(40, 80))]
        for _ in range(3):
            at = rng.randrange(len(words))
            words[at:at] = phrase if k % 4 == 0 else rng.sample(phrase, 4)[:1]
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(k, y) for k, _, y in rows if k < 350], "doc_id long, toxic int"))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    good, bad = ([found[k] for k, _, y in rows if k >= 350 and y == z] for z in (0, 1))
    assert sum(a < b for a in good for b in bad) >= 0.9 * len(good) * len(bad)
