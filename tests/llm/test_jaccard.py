"""Components against all pairs."""

import random
import re

import numpy as np
import pytest

from frostline.llm import common, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})


def brute(docs, percent, size):
    sets = []
    for _, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        sets.append({tuple(w[at : at + size]) for at in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                parent[root(a)] = root(b)
    smallest = {}
    for k, (doc, _) in enumerate(docs):
        smallest[root(k)] = min(doc, smallest.get(root(k), doc))
    return sorted((doc, len(sets[k]), smallest[root(k)]) for k, (doc, _) in enumerate(docs))


def near_copies(seed, passages):
    rng, rows = random.Random(seed), []
    vocabulary = [f"W{k}" for k in range(300)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 9, 12, 20, 40, 80, 300]))]
        for _ in range(rng.choice([1, 2, 3, 8, 20])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            own += [rng.choice(vocabulary) for _ in range(rng.randint(0, max(1, len(own) // 8)) * (rng.random() < 0.3))]
            if passages and rng.random() < 0.5:
                own = shared + own
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(own)))
    return [*rows, (len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n")]


@pytest.mark.parametrize(("seed", "passages"), [(5, False), (6, True)])
def test_against_all_pairs(spark, seed, passages):
    docs = near_copies(seed, passages)
    frame = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, class string").repartition(4)
    found = jaccard.join_components(frame).collect()
    assert sorted(tuple(r) for r in found) == brute(docs, 85, 4)


def test_similar_sets_meet_in_a_signature():
    """The claim behind the candidates, with random sets at the threshold."""
    rng, classes = np.random.default_rng(3), jaccard.SizeClasses(85)
    for size in (6, 7, 12, 13, 40, 41, 200, 900):
        for _ in range(20):
            pool = np.unique(rng.integers(0, 2**63, 3 * size, dtype=np.uint64))
            rng.shuffle(pool)
            differ = int(0.15 * size)
            add = int(rng.integers(0, differ + 1))
            a = np.sort(pool[:size])
            b = np.sort(np.concatenate([pool[differ - add : size], pool[size : size + add]]))
            same = len(np.intersect1d(a, b))
            if 100 * same < 85 * (len(a) + len(b) - same):
                continue
            assert {*jaccard.signatures(a, classes).tolist()} & {*jaccard.signatures(b, classes).tolist()}


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e"), (None, "a b c d e"), (None, None), (3, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in jaccard.join_components(frame).collect()), key=str)
    assert found == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3), (None, 0, None), (None, 2, 1)]
    assert jaccard.join_components(frame.limit(0)).count() == 0


def test_near_copies_that_are_not_linked_leave_few_pairs(spark):
    """They meet in most of their shingles; what leaves the join was held against
    the parities there."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))[:147]
    rows, known, sets = [], [], []
    for number in range(60):
        away = [(at + k) % 147 for at in rng.choice(147, 2, replace=False) for k in range(4)]
        added = rng.integers(0, 2**63, len({*away}), dtype=np.uint64)
        own = np.unique(np.concatenate([np.delete(base, away), added]))
        sets.append({*own.tolist()})
        fine, coarse = (x.tolist() for x in jaccard.parities(own))
        known.append((number, len(own), fine, coarse))
        rows += [(number, len(own), part, own[part::8].astype(np.int64).tolist()) for part in range(8)]
    grams = common.written(spark.createDataFrame(rows, "class long, n long, part int, grams array<long>"), "grams")
    labels = spark.createDataFrame([(k, k) for k in range(60)], "class long, label long")
    sketches = spark.createDataFrame(known, "class long, n long, fine array<long>, coarse array<long>")
    found = {tuple(r) for r in jaccard.across_components(grams, labels, sketches, 85).collect()}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(60) for a in range(b)}
    assert {k for k, x in share.items() if x >= 0.85} <= found
    assert len(found) < len(share) / 8


def test_members_of_signatures_meet_once_and_none_is_lost():
    """Sets with 1024, 2048 and 4096 cells, some within one label."""
    rng, sets = np.random.default_rng(8), []
    for size in (300, 1000, 1030, 2000, 2060):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        sets += [np.unique(base[: int(size * (1 - 0.02 * k))]) for k in range(12)]
    fine = [jaccard.parities(x)[0].view(np.uint64) for x in sets]
    n, label = np.array([len(x) for x in sets]), np.arange(len(sets)) // 2
    found = [tuple(sorted(p)) for x, y in jaccard._met_in_group(fine, n, label, 85) for p in zip(x.tolist(), y.tolist())]
    assert len(found) == len({*found})
    for b in range(len(sets)):
        for a in range(b):
            same = len(np.intersect1d(sets[a], sets[b]))
            linked = 100 * same >= 85 * (n[a] + n[b] - same) and label[a] != label[b]
            assert not linked or (a, b) in found
    assert all(label[a] != label[b] for a, b in found) and len(found) < 400


@pytest.mark.parametrize("members", [1 << 12, 2])
def test_no_shingle_is_shuffled_for_signatures_of_bounded_size(spark, monkeypatch, members):
    """One round with hubs leaves links to the last step; only signatures with
    more members than the limit write their shingles."""
    across, calls = jaccard.across_components, []
    monkeypatch.setattr(jaccard, "across_components", lambda *x: calls.append(x) or across(*x))
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", 1)
    monkeypatch.setattr(jaccard, "MET_MEMBERS", members, raising=False)
    docs = near_copies(7, True)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = jaccard.join_components(frame).collect()
    assert sorted(tuple(r) for r in found) == brute(docs, 85, 4)
    assert bool(calls) == (members == 2)
