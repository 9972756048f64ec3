"""Filter interaction audit by potentials of removal games.

Five filters A to E may fail a document. Per part of the corpus, the removal game
gives every coalition of filters the number of documents that at least one of
them fails. Its potential (Hart and Mas-Colell) is computed recursively over the
32 coalitions,

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,   P(no filter) = 0,

and the Shapley value of a filter is P(all) - P(all without it). Potentials are
kept 120-fold: that makes every one a whole number, and the Shapley value the sum
over the 120 orders of what the filter removes. What a filter removes at a step of
an order is the difference of two coalitions. So all 600 rows of a part come from
its 32 coalition sizes, and documents are read once.

Work on rows: the filters A to D depend on the text alone and are one expression.
E asks for the smallest doc_id of equal texts (by SHA-256). Rows are first counted
by (doc_id, part, text), so neither a hot id nor a hot text meets in one task
before it was combined on the map side; a text then has one row per part and pair
of labels, and only those meet. What is left are at most 32 x 4 cells a part.

Edge cases: a null text is empty (no words: it fails A only, and E as a copy of
another empty one); a null lang is the part ''; a null doc_id is neither smaller
nor larger than others, so it never fails E nor makes another fail, and has no
labels; rows of one doc_id and text do not fail E through each other, and each
counts; of repeated labels one is enough to be good or toxic; null labels count
as none; an empty table gives no rows. Other columns of the inputs, whatever
their names, are not read. Texts of any length are whole.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COALITIONS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOL = "[#$%&*|]"
_COPY = 1 << FILTERS.index("E")
COUNTS = ("documents", "good", "toxic")


def _bits(failures: list[Column]) -> Column:
    """A bit mask of the failed filters, the first one lowest."""
    total = F.lit(0)
    for place, failed in enumerate(failures):
        total = total + F.when(failed, 1 << place).otherwise(0)
    return total


def text_failures(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, part, key (of the text), mask (filters A
    to D that fail it)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", _SPACE), lambda w: w != ""))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    rows = rows.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("key"),
        F.size("words").cast("long").alias("n"),
        F.size(F.array_distinct("words")).cast("long").alias("distinct"),
        capitals.cast("long").alias("capitals"),
        F.length("text").cast("long").alias("length"),
        F.col("text").rlike(_SYMBOL).alias("symbol"),
    )
    mask = _bits(
        [
            F.col("n") < LEAST_WORDS,
            100 * F.col("distinct") < LEAST_DISTINCT * F.col("n"),
            100 * F.col("capitals") > MOST_CAPITALS * F.col("length"),
            F.col("symbol"),
        ]
    )
    return rows.select("doc_id", "part", "key", mask.alias("mask"))


def _labelled(labels: DataFrame) -> DataFrame:
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
    return known.agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, documents): how many documents fail which
    filters. docs: doc_id, text, lang; labels: doc_id, quality, toxic."""
    rows = text_failures(docs).groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("documents"))
    rows = rows.join(_labelled(labels), "doc_id", "left")
    flags = [F.coalesce(x, F.lit(0)).alias(x) for x in ("good", "toxic")]
    rows = rows.select("doc_id", "part", "key", "mask", "documents", *flags)
    known = F.col("doc_id").isNotNull()
    # a doc_id has one row per text here, so the smallest brings its count along
    texts = rows.groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("documents").alias("documents"),
        F.min(F.when(known, F.struct("doc_id", "documents"))).alias("first"),
        F.sum(F.when(~known, F.col("documents")).otherwise(0)).alias("nameless"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("key"))
    spared = F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.documents")).otherwise(0)
    texts = texts.withColumn("spared", spared)
    sides = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("spared").alias("documents")),
        F.struct((F.col("mask") + _COPY).alias("mask"), (F.col("documents") - F.col("spared")).alias("documents")),
    )
    sides = texts.select("part", "good", "toxic", F.explode(sides).alias("side"))
    cells = sides.filter("side.documents > 0").groupBy("part", F.col("side.mask").alias("mask"), "good", "toxic")
    return cells.agg(F.sum("side.documents").alias("documents"))


def removal_games(cells: DataFrame) -> DataFrame:
    """(part, documents, game): for every coalition, numbered by its bits, how
    many documents, good and toxic ones it removes."""
    sizes = cells.select(
        "part",
        "mask",
        "documents",
        (F.col("documents") * F.col("good")).alias("good"),
        (F.col("documents") * F.col("toxic")).alias("toxic"),
        F.explode(F.sequence(F.lit(0), F.lit(COALITIONS - 1))).alias("coalition"),
    )
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    sizes = sizes.groupBy("part", "coalition").agg(
        F.sum("documents").alias("total"), *(F.sum(F.when(hit, F.col(x)).otherwise(0)).alias(x) for x in COUNTS)
    )
    # 32 coalitions a part
    games = sizes.groupBy("part").agg(
        F.max("total").alias("documents"), F.array_sort(F.collect_list(F.struct("coalition", *COUNTS))).alias("game")
    )
    return games


def potentials(removed: Column) -> Column:
    """The potential of every coalition, times the number of orders, from what
    every coalition removes. A coalition comes after all of its parts."""

    def extended(found: Column, coalition: Column) -> Column:
        total = F.get(removed, coalition) * factorial(len(FILTERS))
        for place in range(len(FILTERS)):
            without = F.get(found, coalition - (1 << place))
            total = total + F.when(F.getbit(coalition, F.lit(place)) == 1, without).otherwise(0)
        return F.concat(found, F.array(F.call_function("div", total, F.bit_count(coalition))))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(COALITIONS - 1)), F.array(F.lit(0).cast("long")), extended
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters, and step: what the step's filter
    does there."""
    games = removal_games(failure_cells(docs, labels))
    games = games.withColumn("potential", potentials(F.transform("game", lambda x: x["documents"])))
    orders = F.array(*(F.lit("".join(x)) for x in permutations(FILTERS)))
    rows = games.withColumn("filter_order", F.explode(orders))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    own = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    before = _bits([F.instr("filter_order", x) < F.col("step") for x in FILTERS])
    rows = rows.withColumns({"own": own, "before": before})

    def at(coalition: Column, count: str) -> Column:
        return F.get("game", coalition)[count]

    everyone = F.lit(COALITIONS - 1)
    others = everyone - F.col("own")
    after = F.col("before") + F.col("own")

    def removed(count: str) -> Column:
        return at(after, count) - at(F.col("before"), count)

    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("documents") - at(after, "documents")).alias("kept"),
        removed("documents").alias("removed"),
        (at(F.col("own"), "documents") - removed("documents")).alias("redundant"),
        (at(everyone, "documents") - at(others, "documents")).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        (F.get("potential", everyone) - F.get("potential", others)).alias("shapley"),
    )
