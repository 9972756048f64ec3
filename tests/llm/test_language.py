"""Profiles against their definition, and accuracy on held-out documents."""

import zlib

import numpy as np

from frostline.llm import language


def test_profile_is_the_sum_of_bound_letters():
    maker = language.Profiles()
    found = maker.profile("Ab, a!")
    vector = {x: maker.tables[language.NGRAM - 1, maker.row[ord(x) if x else 0]].astype(int) for x in ("a", "b", "")}
    signs = ["", "a", "b", "", "a", ""]
    total = sum(
        np.roll(vector[x], 2) * np.roll(vector[y], 1) * vector[z] for x, y, z in zip(signs, signs[1:], signs[2:])
    )
    assert np.allclose(found, total / np.sqrt((total * total).sum()))
    assert maker.profile(None) is None and maker.profile("12 .") is None and maker.profile("x") is not None


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = {r["doc_id"]: r["lang"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    prototypes = language.learn(docs.filter(~docs["doc_id"].isin(list(held))))
    found = language.predict(docs.select("doc_id", "text"), prototypes).collect()
    right = [r["lang_pred"] == held[r["doc_id"]] for r in found if r["doc_id"] in held]
    assert len(right) == len(held) and sum(right) >= 0.97 * len(right)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string, kept long"
    known = [(k, "der die das und", "de", "s", 1) for k in range(5)] + [(9, "the and of it", "en", "s", 1)]
    prototypes = language.learn(spark.createDataFrame([*known, (10, None, "fr", "s", 1), (11, "x", None, "s", 1)], schema))
    assert sorted(prototypes) == ["de", "en"]
    asked = [(1, None, "en", "s", 1), (2, "", None, "s", 1), (3, "42", "en", "s", 1), (4, "Das und die " * 20000, "x", "s", 1)]
    asked = spark.createDataFrame(asked, schema)
    found = {r["doc_id"]: r for r in language.predict(asked, prototypes).collect()}
    assert [found[k]["lang_pred"] for k in (1, 2, 3, 4)] == ["und", "und", "und", "de"]
    assert found[1]["kept"] == 1 and found[1]["score"] == 0.0
    assert {r["lang_pred"] for r in language.predict(asked, {}).collect()} == {"und"}
    assert language.predict(asked.limit(0), prototypes).count() == 0
    assert language.learn(asked.limit(0)) == {}
