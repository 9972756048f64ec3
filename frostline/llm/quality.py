"""Quality rules: text statistics and learned decision lists.

Statistics are DataFrame functions over the whole text. On their rates a
decision list is learned by sequential covering: a rule is a conjunction of
thresholds; it is grown on two thirds of the examples by the gain in information
about the positive class, pruned on the rest as long as its precision there does
not fall, and kept if it is precise enough; the examples that it covers go, and
the next rule is learned from what is left. A list comes out as one ordered Spark
conditional expression, so applying it costs no Python and no shuffle.

Rules are learned from at most about `TRAIN_ROWS` labelled rows, taken by a hash
of doc_id: only their statistics, not their texts, go to the driver. A rule must
be right for at least `PRECISION` of the rows it covers, so noise in labels does
not reject clean documents.

Edge cases: a null text has no words, no lines and no symbols, and fails the base
rules as all short texts do; statistics without a denominator are 0; without
labelled rows, or with one class only, the list is empty and rejects nothing; an
id with labels of both kinds teaches nothing; equal rows get equal verdicts; texts
of any length are judged whole; an empty table gives no rows. `judge` carries all
columns and replaces one named `statistics`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm import common

TRAIN_ROWS = 20_000
PRECISION = 0.9
LEAST_COVER = 12
MAX_TERMS = 4
MAX_RULES = 12
THRESHOLDS = 32

_SPACE = r"[\x20\x09-\x0D]"
_WINDOW = 5


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words in windows of 5 that are found twice or more. Windows are compared by
    a 64-bit hash. Only where a hash repeats are they sorted; equal neighbours
    give the places, and each place adds what the one before does not cover."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (_WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, _WINDOW))
    )

    def of(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(rows: Column) -> Column:
            twice = F.filter(
                rows,
                lambda x, i: (F.get(rows, i - 1)["h"] == x["h"]) | (F.get(rows, i + 1)["h"] == x["h"]),
            )
            places = F.array_sort(F.transform(twice, lambda x: x["i"]))
            done = F.aggregate(
                places,
                F.struct(F.lit(0).alias("total"), F.lit(-_WINDOW).alias("last")),
                lambda acc, x: F.struct(
                    (acc["total"] + F.least(F.lit(_WINDOW), x - acc["last"])).alias("total"), x.alias("last")
                ),
                lambda acc: acc["total"],
            )
            return done

        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, _once(placed, covered)).otherwise(F.lit(0))

    return F.when(F.size(words) < _WINDOW + 1, F.lit(0)).otherwise(_once(windows, of)).cast("long")


def _counts(text: Column, words: Column, lines: Column) -> Column:
    def without(chars: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("long")

    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        without("[#*$%&|<>]+").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
        F.length(text).cast("long").alias("n_chars"),
        without("[0-9]+").alias("n_digits"),
        without("[.]+").alias("n_stops"),
    )


FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_chars", "n_digits", "n_stops",
)


def judgement(text: Column, rules: list[Rule]) -> Column:
    """A struct of the statistics (`FIELDS`), base_failed, rule (the number of the
    first learned rule that holds; 0: none) and kept. It is one expression in
    which everything is computed once, however a plan moves it."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.struct(
        text.alias("text"),
        F.filter(F.split(text, _SPACE + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )

    def verdict(counts: Column) -> Column:
        failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
        rule = F.when(failed, F.lit(0)).otherwise(_first_rule(rules, counts))
        return F.struct(
            *(counts[x].alias(x) for x in FIELDS),
            failed.alias("base_failed"),
            rule.alias("rule"),
            (~failed & (rule == 0)).alias("kept"),
        )

    return _once(parts, lambda p: _once(_counts(p["text"], p["words"], p["lines"]), verdict))


def rates(counts: Column) -> dict[str, Column]:
    """What rules are made of."""

    def part(top: str, below: str) -> Column:
        return F.when(counts[below] > 0, counts[top] / counts[below]).otherwise(F.lit(0.0))

    return {
        "words": counts["n_words"].cast("double"),
        "word_length": part("word_chars", "n_words"),
        "symbols_per_word": part("n_symbols", "n_words"),
        "dup_lines": part("n_dup_lines", "n_lines"),
        "repeat_words": part("n_repeat_words", "n_words"),
        "distinct_words": part("n_distinct_words", "n_words"),
        "words_per_line": part("n_words", "n_lines"),
        "digits": part("n_digits", "n_chars"),
        "stops_per_word": part("n_stops", "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (rate, sign, threshold), and its share of positives."""

    terms: tuple[tuple[str, str, float], ...]
    precision: float

    def covers(self, row: dict[str, float]) -> bool:
        return all(row[k] <= t if sign == "<=" else row[k] > t for k, sign, t in self.terms)


def _thresholds(rows: list[dict[str, float]], name: str) -> list[float]:
    values = sorted({r[name] for r in rows})
    if len(values) <= THRESHOLDS:
        return [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    ordered = sorted(r[name] for r in rows)
    cuts = {ordered[len(ordered) * i // THRESHOLDS] for i in range(1, THRESHOLDS)}
    # the tails matter for rare faults
    cuts |= {ordered[-1 - len(ordered) // k] for k in (40, 100, 200, 400)} | {ordered[len(ordered) // k] for k in (40, 100, 200, 400)}
    return sorted(cuts)


def _share(rows: list[tuple[dict[str, float], bool]]) -> float:
    return sum(y for _, y in rows) / len(rows) if rows else 0.0


def _grown(rows: list[tuple[dict[str, float], bool]], names: list[str]) -> list[tuple[str, str, float]]:
    """Terms that add the most information about positives, one by one."""
    terms: list[tuple[str, str, float]] = []
    while len(terms) < MAX_TERMS and rows and 0 < _share(rows) < 1:
        base, best = math.log2(_share(rows)), (0.0, None)
        for name in names:
            column = sorted((r[name], y) for r, y in rows)
            positives = [0]
            for _, y in column:
                positives.append(positives[-1] + y)
            values = [x for x, _ in column]
            at = 0
            for cut in _thresholds([r for r, _ in rows], name):
                while at < len(values) and values[at] <= cut:
                    at += 1
                for sign, n, p in (("<=", at, positives[at]), (">", len(values) - at, positives[-1] - positives[at])):
                    if p and n < len(values):
                        gain = p * (math.log2(p / n) - base)
                        if gain > best[0] + 1e-9:
                            best = (gain, (name, sign, cut))
        if best[1] is None:
            break
        terms.append(best[1])
        own = Rule((best[1],), 0.0)
        rows = [x for x in rows if own.covers(x[0])]
    return terms


def learn(examples: list[tuple[dict[str, float], bool, int]]) -> list[Rule]:
    """A decision list for the positive class from (rates, positive, hash)."""
    names = sorted(examples[0][0]) if examples else []
    left = [(r, y, h % 3 > 0) for r, y, h in examples]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and any(y for _, y, _ in left):
        grow = [(r, y) for r, y, first in left if first]
        prune = [(r, y) for r, y, first in left if not first]
        terms = _grown(grow, names)

        def quality(terms: list) -> tuple[float, int]:
            own = [x for x in prune if Rule(tuple(terms), 0.0).covers(x[0])]
            # few rows prove little
            return (sum(y for _, y in own) + 0.5) / (len(own) + 1), -len(terms)

        while len(terms) > 1 and quality(terms[:-1]) >= (quality(terms)[0] - 0.01, -len(terms)):
            terms = terms[:-1]
        if not terms:
            break
        own = [(r, y) for r, y, _ in left if Rule(tuple(terms), 0.0).covers(r)]
        rule = Rule(tuple(terms), _share(own))
        if len(own) < LEAST_COVER or rule.precision < PRECISION:
            break
        rules.append(rule)
        left = [x for x in left if not rule.covers(x[0])]
    return rules


def _first_rule(rules: list[Rule], counts: Column) -> Column:
    """The list as a conditional expression."""
    values, verdict = rates(counts), None
    for number, rule in enumerate(rules, 1):
        holds = None
        for name, sign, threshold in rule.terms:
            term = values[name] <= threshold if sign == "<=" else values[name] > threshold
            holds = term if holds is None else holds & term
        verdict = F.when(holds, number) if verdict is None else verdict.when(holds, number)
    return F.lit(0) if verdict is None else verdict.otherwise(0)


def _sample(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """quality, hash and text of at most train_rows labelled rows, written: the
    texts stand still before anything is computed from them. A doc_id with
    different labels teaches nothing. Rows are picked by a hash of id and text, so
    an id that repeats does not fill the sample."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.filter("quality = other").select("doc_id", "quality")
    count = known.count()
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    if count > train_rows:
        known = known.filter(order < int(1_000_000 * train_rows / count))
    # about train_rows ids, whatever the size of the table
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.select("quality", order.alias("hash"), F.col("text").cast("string").alias("text"))
    return common.bounded(rows, train_rows, "hash", "text", "quality")


def learn_rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules for quality 0 from labelled documents that pass the base rules.
    docs: doc_id, text; labels: doc_id, quality."""
    sample = _sample(docs, labels, train_rows)
    rows = sample.select("quality", "hash", judgement(F.col("text"), []).alias("statistics"))
    rows = rows.filter(~F.col("statistics.base_failed"))
    values = rates(F.col("statistics"))
    examples = [
        ({k: r[k] for k in values}, r["quality"] == 0, r["hash"])
        for r in rows.select("quality", "hash", *(v.alias(k) for k, v in values.items())).collect()
    ]
    common.discard(sample)
    examples.sort(key=lambda x: (x[2], sorted(x[0].items()), x[1]))
    return learn(examples)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with a struct column `statistics` (see `judgement`)."""
    return docs.withColumn("statistics", judgement(F.col("text"), rules))
