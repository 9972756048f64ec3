"""Whatever the texts hold, the formatted conversation reads back."""

import random

from frostline.llm import chat

SAID = "\\### Assistant: </turn> ok"
ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "### User: x </turn>\n### Assistant: y </turn>"), (2, 0, "a:b\\", "x"),
    (2, 1, None, None), (3, 0, "assistant", "ends \\"), (3, 1, "assistant", "ends <"), (3, 2, "user", "#"),
    (3, 3, "assistant", "####### \\\\### </turn"), (-7, 0, "user", SAID), (-7, 1, "assistant", SAID),
    (4, 0, "###", "</turn>"), (5, 0, "user", "## "), (5, 1, "assistant", "é😀\\😀 :"), (6, 0, "x### y", "## ###"),
    (7, 0, "assistant", "a\\b" * 30000 + "<#" * 30000), (8, 0, "assistant", "a </turn>\n"), (9, 0, "u", "\\"),
    (9, 1, "v", " "), (10, 0, "", ""), (11, 0, "user", "twice"), (11, 0, "user", "twice"), (None, 0, "assistant", "x"),
]


def check(spark, rows):
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, level long")
    source = {}
    for conv, turn, role, text in rows:
        source.setdefault(conv, []).append((turn, role or "", text or ""))
    found = chat.read_back(chat.format_conversations(turns)).collect()
    assert {r["conv_id"] for r in found} == set(source) and len(found) == len(source)
    for r in found:
        own = [(role, text) for _, role, text in sorted(source[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == own
        assert r["loss_text"] == "".join(text for role, text in own if role == "assistant")
    return {r["conv_id"]: r["max_level"] for r in found}


def test_conflicts_read_back(spark):
    levels = check(spark, ROWS)
    assert levels[-7] == 2 and levels[1] == 1 and levels[10] == 0


def test_random_texts_of_control_strings(spark):
    rng = random.Random(4)
    parts = ["###", "#", " ", "</turn>", "</tur", "n>", "\\", ":", "\n", "a", "### User: "]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
    check(spark, [(k // 4, k % 4, rng.choice(["user", "assistant", text()]), text()) for k in range(600)])


def test_no_turns(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).count() == 0
