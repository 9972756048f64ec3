"""Ranks and distances against dense shares in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest

from frostline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})


def brute(docs, least, top):
    counts, holders, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        terms = TERM.findall((text or "").translate(LOW))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        holders[lang or ""].update(set(terms))
    kept = {lang: sorted(t for t, n in own.items() if n >= least) for lang, own in holders.items()}
    total = defaultdict(Counter)
    for (lang, _), own in counts.items():
        total[lang].update(own)

    def shares(own, lang):
        n, v = sum(own[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (own[t] + 5) // (n + 5 * v) for t in kept[lang]}

    out = []
    for lang, source in groups:
        p, q = shares(counts[lang, source], lang), shares(total[lang], lang)
        items = [(t, p[t] - q[t]) for t in kept[lang] if counts[lang, source][t] and p[t] > q[t]]
        items.sort(key=lambda x: (-x[1], x[0].encode()))
        out += [(lang, source, "term", t, f, k) for k, (t, f) in enumerate(items[:top], 1)]
        others = []
        for other in (s for g, s in groups if g == lang and s != source):
            r = shares(counts[lang, other], lang)
            others.append((other, sum(abs(p[t] - r[t]) for t in kept[lang])))
        others.sort(key=lambda x: (-x[1], x[0].encode()))
        out += [(lang, source, "pair", s, f, k) for k, (s, f) in enumerate(others, 1)]
    return sorted(out)


def found(spark, docs, least, top):
    frame = spark.createDataFrame([(*x, 1, "t") for x in docs], "text string, lang string, source string, count int, term string")
    return sorted(tuple(r) for r in divergence.audit(frame.repartition(3), least, top).collect())


def random_docs(seed, rows):
    rng = random.Random(seed)
    vocabulary = ["Der", "der", "ÄÖ", "äö", "日本", "z😀z", "x", *(f"w{'abcdefgh'[k % 8]}{'xyzuv'[k % 5]}" for k in range(40))]
    docs = []
    for _ in range(rows):
        own = vocabulary[rng.randrange(20) :]
        words = [rng.choice(own) for _ in range(rng.choice([0, 1, 5, 40]))]
        text = "".join(w + rng.choice([" ", "-", "\n", "1", "[", "`", "\x7f"]) for w in words)
        docs.append((rng.choice([text, text, None]), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "ç", "", None, "d"])))
    return docs


@pytest.mark.parametrize(("seed", "rows", "least", "top", "block"), [(1, 300, 3, 5, 7), (2, 120, 6, 50, 4096), (3, 40, 1, 3, 50)])
def test_against_dense_shares(spark, monkeypatch, seed, rows, least, top, block):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", block)
    docs = random_docs(seed, rows)
    assert found(spark, docs, least, top) == brute(docs, least, top)


def test_groups_without_terms_ties_and_no_rows(spark):
    docs = [("gleich anders", "de", "a")] * 4 + [("anders gleich", "de", "b")] * 4
    docs += [(None, "de", "c"), ("1 2 3", "de", "d"), ("allein", "fr", "x"), ("", None, None), ("selten", "fr", "y")]
    docs += [("wort " * 50000, "es", "x"), ("wort", "es", "y")]
    for least, top in ((2, 50), (2, 1), (9, 50)):
        assert found(spark, docs, least, top) == brute(docs, least, top)
    assert found(spark, [], 1, 5) == []


def test_shares_of_very_large_counts(spark):
    """Products beyond 64 bits."""
    row = spark.sql("SELECT 900000000000000 AS c, 4000000000000000 AS n, 1000 AS v")
    assert row.select(divergence.share(row["c"], "n", "v")).first()[0] == 1 + 10**9 * (9 * 10**14 + 5) // (4 * 10**15 + 5000)


def test_common_sums():
    rng = random.Random(5)
    z = {s: rng.randrange(1, 50) for s in "abcd"}
    rows = [("en", s, t, rng.randrange(1, 99), z[s]) for t in range(30) for s in "abcd" if rng.random() < 0.6]
    got = divergence.common_sums(pd.DataFrame(rows, columns=["lang", "source", "term", "p", "z"]))
    want = Counter()
    for _, a, t, p, x in rows:
        for _, b, u, q, y in rows:
            if t == u and a < b:
                want[a, b] += abs(p - q) - abs(x - q) - abs(p - y) + abs(x - y)
    assert {(r.of, r.other): r.value for r in got.itertuples()} == {(a, b): want[a, b] for a, b in want}
