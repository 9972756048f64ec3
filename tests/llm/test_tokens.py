"""Token ids against the library, the code files against the ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from frostline.llm import common, token_codes
from frostline.llm.tokens import TOGETHER, Encoder

TEXTS = [
    "a  b", "a   b x..y", "\n\n a\tb", "Don't  stop.\n \nIt's 3.14,5 '' .. ,", " x", "x ", "", None, "Σας ΟΔΟΣ. é é ́x",
    "<|endoftext|> a <|endoftext|>", "a_. b ._c", "a\nb", "\na b.\nC, d", "a, b;\x1cc \x02d", "x.\n", "İI ǅ , .",
    "a b", "\n", "\x02", "a\x85b", "é.", "words and words, " * 3000, "😀 \U0001f1e9\U0001f1ea ",
]


def library_ids(name, end, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [tokenizer.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("pieces", [3, 100_000])
def test_pieces_give_the_library_ids(name, pieces):
    encoder = Encoder(name, 2, pieces)
    for _ in range(2):
        found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(TEXTS)]
        assert found == library_ids(name, 2, TEXTS)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_random_strings(name):
    """Stops, case that folds to several characters, marks, specials, space."""
    rng = random.Random(7)
    signs = ["a", "İ", "I", "ß", "é", "e\u0301", "\u0307", "ǅ", "Σ", "ª", "º", "µ", "1", "²", ".", ",", ";", ":", "'s", "'", "\n", "\t", " ", "  "]
    signs += ["<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "\xa0", "\u2003", "\u0345", "漢", "😀", "\x1c", "\x85", "Word", "word."]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    encoder = Encoder(name, 2)
    wanted = library_ids(name, 2, texts)
    for at in range(0, len(texts), 500):
        found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts[at : at + 500])]
        assert found == wanted[at : at + 500]


def test_special_strings(spark):
    """By default as the library reads them, or as ordinary text."""
    text = "a <|endoftext|> b"
    found = [np.frombuffer(Encoder("byte_bpe_50k.json", 0, special_as_text=x).encode([text])[0], "<u4").tolist() for x in (False, True)]
    assert 50256 in found[0] and 50256 not in found[1] and len(found[1]) > len(found[0])


@pytest.mark.parametrize("size", [0, 1, 7, 8, 511, 512, 513, 5000])
def test_levels_keep_every_id(size):
    ids = np.random.default_rng(size).choice([0, 255, 256, 65535, 65536, 2**32 - 1, 49406], size).astype(np.uint32)
    levels = token_codes.split_levels(ids)
    assert token_codes.join_levels(levels).tolist() == ids.tolist()
    assert [token_codes.token_at(levels, k) for k in range(size)] == ids.tolist()


def test_files_read_back(spark, monkeypatch):
    monkeypatch.setattr(token_codes, "SEGMENT_TOKENS", 50)
    rows = [(3 * k - 9, x, "n") for k, x in enumerate(TEXTS)] + [(-9, "a  b", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(5)
    path = common.new_path(spark, "codes")
    token_codes.write_codes(docs, path, "word_bpe_49k.json", 2)
    found = sorted(token_codes.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted(x[0] for x in rows)
    ids = {(a, b): c for (a, b, _), c in zip(rows, library_ids("word_bpe_49k.json", 2, [x[1] for x in rows]), strict=True)}
    start = 0
    for r in found:
        own = next(v for (k, _), v in ids.items() if k == r["doc_id"])
        crc = zlib.crc32(np.asarray(own, "<u4").tobytes())
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), crc)
        start += len(own)


def test_no_documents(spark):
    path = common.new_path(spark, "codes")
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_codes.write_codes(docs, path, "word_bpe_49k.json", 2)
    assert token_codes.read_documents(spark, path).count() == 0


def test_a_block_looks_up_each_distinct_piece_once(monkeypatch):
    """Signs and line feeds make no pieces of their own with the words beside
    them, and new words share calls."""
    words = ["alpha", "beta", "gamma"]
    texts = ["\n".join(f"{a}, {b}***" for a in words) + f" {b}.\n{a}" for a in words for b in words for _ in range(20)]
    encoder = Encoder("byte_bpe_50k.json", 0)
    found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert found == library_ids("byte_bpe_50k.json", 0, texts)
    assert not any(b"\n" in x.strip(b"\x02\n") for x in encoder.memory)
    calls = []
    monkeypatch.setattr(encoder, "_ids", lambda text, own=encoder._ids: calls.append(text) or own(text))
    new = [f"word{k}x" for k in range(TOGETHER)]
    found = encoder.encode([" ".join(["alpha", *new])])
    assert np.frombuffer(found[0], "<u4").tolist() == library_ids("byte_bpe_50k.json", 0, [" ".join(["alpha", *new])])[0]
    assert len(calls) == 1 and sorted(calls[0].split()) == sorted(new)
