"""The pipeline's stages against their operators' rules on whole tables."""

import random

import corpus_pipeline
from test_decontaminate import brute as brute_items
from test_jaccard import brute as brute_groups

from frostline.llm import common


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    before, columns = docs, docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        after = common.written(stage(spark, before, sf_dir), "test-stage")
        if number < 5:
            assert after.columns == columns and after.dtypes == docs.dtypes
            assert set(rows(after)) <= set(rows(before))
        if number == 3:
            groups = brute_groups(rows(before), 80, 5)
            assert sorted(r["doc_id"] for r in after.collect()) == sorted({x[2] for x in groups})
        if number == 4:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            clean = {doc for doc, x in brute_items(rows(before), items, 10).items() if not x[1]}
            assert {r["doc_id"] for r in after.collect()} == clean
        if number == 5:
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
        before = after


def test_odd_rows_pass_through_every_stage(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, statistics string, score long"
    good = " ".join(f"wort{k}" for k in range(40))
    odd = [(None, good, None, None, None, "s", 1), (1, None, "en", "a", 0, None, None), (2, "", None, None, 0, "s", 1)]
    odd += [(3, good + " ende", "en", "a", 1, "s", 1)] * 2 + [(4, " ".join(f"x{k % 9000}" for k in range(20000)), "en", "a", 1, "s", 1)]
    docs = spark.createDataFrame(odd, schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert out.count() <= frame.count() + 40
    third = corpus_pipeline.STAGES[2][1](spark, docs, sf_dir)
    assert third.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in third.collect()) == [1, 2, 3, 4]


def test_near_copies_at_five_words_and_80_percent(spark, sf_dir):
    """Copies that only lack their end (0.83), or have edits spread over them."""
    rng, docs = random.Random(4), []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 400]))]
        docs.append((len(docs), " ".join(words)))
        docs.append((len(docs), " ".join(words[: int(len(words) * rng.choice([0.79, 0.83, 0.9]))])))
        for _ in range(rng.choice([1, 2, len(words) // 50])):
            words[rng.randrange(len(words))] = "edited"
        docs.append((len(docs), " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, sf_dir).collect())
    assert kept == sorted({x[2] for x in brute_groups(docs, 80, 5)})
    assert len(kept) < len({x[2] for x in brute_groups(docs, 85, 4)})


def test_toxic_by_the_operators_verdict(spark, sf_dir, monkeypatch):
    docs = spark.createDataFrame([(k, str(k / 10)) for k in range(10)], "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline.toxicity, "learn", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "score", lambda x, _: x.withColumn("score", x["text"].cast("double")))
    kept = sorted(r["doc_id"] for r in corpus_pipeline.toxic_documents(spark, docs, sf_dir).collect())
    assert kept == [0, 1, 2]


def test_rows_of_one_or_no_doc_id_are_judged_by_their_texts(spark, sf_dir):
    text = lambda name, count=30: " ".join(f"{name}{k}" for k in range(count))
    docs = [(None, text(x)) for x in "abc"] + [(None, text("a", 31)), (7, text("d")), (7, text("e")), (7, text("e")), (9, text("d", 31))]
    docs += [(5, text("b", 31)), (7, text("d", 31)), (None, None), (7, ""), (7, " \n")]
    frame = spark.createDataFrame([(*x, k % 2) for k, x in enumerate(docs)], "doc_id long, text string, n long").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, frame, sf_dir)
    assert kept.columns == frame.columns and kept.dtypes == frame.dtypes
    wanted = [(None, text("a")), (None, text("c")), (5, text("b", 31)), (7, text("d")), (7, text("e"))]
    assert rows(kept) == sorted([*wanted, (None, None), (7, ""), (7, " \n")], key=str)
