"""Statistics against plain Python, rules on planted faults."""

import random
import re

from pyspark.sql import functions as F

from frostline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words, windows, covered, seen, dup = WORD.findall(text), {}, set(), set(), 0
    for at in range(len(words) - 4):
        windows.setdefault(tuple(words[at : at + 5]), []).append(at)
    for places in windows.values():
        if len(places) > 1:
            for at in places:
                covered.update(range(at, at + 5))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(text.count(x) for x in "#*$%&|<>")
    n, repeated = len(words), len(covered)
    return n, sum(map(len, words)), symbols, dup, repeated, n < 10 or 100 * repeated > 20 * n


def test_statistics(spark):
    rng = random.Random(3)
    parts = ["a", "b", "é😀", "#|", " ", "\n", "\t", "\x0b", "\xa0", " ", "\r\n", "a b a b c\n", "9."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += [None, "", "\n\n", "a " * 40000, "x y z w v " * 3, " ".join(map(str, range(30)))]
    rows = [(k, t, 5, {"x": 1}) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words long, lines map<string, int>")
    found = quality.judge(docs, []).select("doc_id", "words", "statistics.*").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r["doc_id"]: tuple(r[x] for x in names) for r in found} == dict(enumerate(map(plain, texts)))
    assert all(r["kept"] == (not r["base_failed"]) and r["words"] == 5 for r in found)
    assert quality.judge(docs.limit(0), []).count() == 0


def test_planted_faults_are_learned(spark):
    rng, rows = random.Random(8), []
    for k in range(900):
        words = [rng.choice("abcdefghij") * rng.randint(2, 7) + str(k % 7 * 0 or "") for _ in range(rng.randint(20, 60))]
        bad = k % 6 == 0
        if bad:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        # a few wrong labels
        rows.append((k, " ".join(words), int(not bad) if k % 41 else int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    rules = quality.learn_rules(docs, labels)
    assert rules and all(r.precision >= quality.PRECISION for r in rules)
    verdicts = {r["doc_id"]: r["kept"] for r in quality.judge(docs, rules).select("doc_id", "statistics.kept").collect()}
    assert all(verdicts[k] == (k % 6 != 0) for k in range(900))
    # the expression and the rule objects agree
    values = quality.rates(F.col("statistics"))
    rated = quality.judge(docs, rules).select("statistics.rule", *(v.alias(k) for k, v in values.items())).collect()
    for r in rated:
        row = {k: r[k] for k in values}
        assert r["rule"] == next((n for n, x in enumerate(rules, 1) if x.covers(row)), 0)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, None)], [(1, 0), (2, 0)], [(None, 0)]):
        assert quality.learn_rules(docs, spark.createDataFrame(rows, "doc_id long, quality int")) == []
