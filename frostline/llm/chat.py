"""Chat formatting with a grammar that is read back.

    conversation = { turn }
    turn = "### " role ": " body " </turn>" LF

The parser reads a turn by one regular expression: a role ends at the first
colon, a body at the first close mark, both not escaped; a backslash stands
before a character that is meant as itself. Texts are first written as they are,
and the result is parsed. Where the recovered turns differ from the source, the
turns in conflict are written again with the control strings escaped, parsed
again, and where that does not restore them either, with every backslash and `#`
escaped as well. The last form always reads back: each backslash, `#` and close
mark of the text stands behind a backslash, so no mark begins inside it, and
dropping one backslash before each character gives the text again.

The output has one row per conversation: the formatted text and the spans of the
loss mask, as code points: the bodies of assistant turns, without the marks.

Everything is DataFrame functions. Turns are rendered and tested one row each,
before they are grouped; what a group gathers is the conversation itself.

Edge cases: a null text or role is empty; rows of one turn number follow in the
order of role and text, repeated rows are kept; a null conv_id is a conversation
of its own; no rows, no conversations; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", " </turn>\n"
LOSS_ROLE = "assistant"

# possessive, so the engine neither backtracks nor recurses on long texts
_CHARS = r"(?:[^\\<#:]++|\\.|<(?!/turn>)|#(?!## )%s)*+"
_ROLE = _CHARS % ""
_BODY = _CHARS % "|:"
_TURN = rf"(?s)### ({_ROLE}): ({_BODY})</turn>\n"


def _escaped(text: Column, level: Column) -> Column:
    """Level 0: as it is; 1: control strings escaped; 2: backslashes and every
    `#` as well."""
    light = F.replace(text, F.lit("###"), F.lit("\\###"))
    full = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#"))
    marks = F.replace(F.when(level == 2, full).otherwise(light), F.lit("</turn>"), F.lit("\\</turn>"))
    return F.when(level == 0, text).otherwise(marks)


def _rendered(role: Column, text: Column, level: Column) -> Column:
    escaped_role = F.replace(_escaped(role, level), F.lit(":"), F.lit("\\:"))
    named = F.when(level == 0, role).otherwise(escaped_role)
    return F.concat(F.lit(OPEN), named, F.lit(": "), _escaped(text, level), F.lit(CLOSE))


def plain(escaped: Column) -> Column:
    """Without the escaping backslashes."""
    return F.regexp_replace(escaped, r"(?s)\\(.)", "$1")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation. The space before a
    close mark belongs to the mark."""
    roles = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2))
    return F.transform(
        F.arrays_zip(roles.alias("role"), bodies.alias("body")),
        lambda x: F.struct(
            plain(x["role"]).alias("role"), plain(x["body"].substr(F.lit(1), F.length(x["body"]) - 1)).alias("text")
        ),
    )


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn, rendered at the lowest level of escaping that reads
    back: conv_id, turn, role, text, level, rendered."""
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    role, text = F.col("role"), F.col("text")
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    rows = rows.withColumn("level", F.lit(0)).withColumn("rendered", _rendered(role, text, F.lit(0)))
    for level in (1, 2):
        kept = parse(F.col("rendered")) == source
        # a mark that a turn leaves open could swallow the next one
        alone = F.regexp_replace("rendered", _TURN, "") == ""
        rows = rows.withColumn("level", F.when(kept & alone, F.col("level")).otherwise(F.lit(level)))
        again = _rendered(role, text, F.lit(level))
        rows = rows.withColumn("rendered", F.when(F.col("level") == level, again).otherwise(F.col("rendered")))
    return rows


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, length>> (code points,
    from 0, in order), max_level."""
    rows = format_turns(turns)
    body = F.length("rendered") - len(CLOSE)
    head = F.length(F.concat(F.lit(OPEN), F.lit(": "))) + F.length(
        F.regexp_extract("rendered", rf"(?s)^### ({_ROLE}): ", 1)
    )
    row = F.struct(
        "turn",
        "role",
        "text",
        F.col("rendered"),
        F.length("rendered").alias("size"),
        head.alias("head"),
        (body - head).alias("body"),
    )
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(row)).alias("rows"), F.max("level").alias("max_level")
    )
    spans = F.aggregate(
        "rows",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans")),
        lambda done, x: F.struct(
            (done["at"] + x["size"]).alias("at"),
            F.when(
                x["role"] == LOSS_ROLE,
                F.concat(
                    done["spans"],
                    F.array(
                        F.struct(
                            (done["at"] + x["head"]).cast("long").alias("start"), x["body"].cast("long").alias("length")
                        )
                    ),
                ),
            )
            .otherwise(done["spans"])
            .alias("spans"),
        ),
        lambda done: done["spans"],
    )
    return grouped.select(
        "conv_id", F.array_join(F.col("rows.rendered"), "").alias("formatted"), spans.alias("loss_spans"), "max_level"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the loss text as the output gives them: conv_id, turns,
    loss_text, formatted_chars."""
    masked = F.transform(
        "loss_spans",
        lambda x: plain(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int"))),
    )
    return formatted.select(
        "conv_id",
        parse(F.col("formatted")).alias("turns"),
        F.array_join(masked, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "max_level",
    )
