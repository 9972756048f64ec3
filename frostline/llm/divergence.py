"""Source divergence audit by count cells.

A term's share in a group is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), and
sources are compared with their language and with each other by |p - q|. Both
shares depend on two counts only, so terms are handled by cells of equal counts.

Terms against the language: terms of a group fall into cells (group count, lang
count). The difference is computed once per cell, cells of equal difference are
merged, and ranked by how many terms lie before them. Only cells that begin among
the first `TOP` ranks are expanded to terms, in UTF-8 order.

Sources against each other: with z the share of a term that a group lacks,

    sum over all kept terms of |p_g - p_h|
      = sum over h's terms of |z_g - p_h| + (V - terms of h) |z_g - z_h|
      + the same with g and h exchanged
      - V |z_g - z_h|
      + sum over common terms of |p_g - p_h| - |z_g - p_h| - |p_g - z_h| + |z_g - z_h|.

The first sums come from cells (source, count): running counts and sums over the
shares of h, read at z_g. The last one needs the terms that both have: terms are
dealt into blocks of about `BLOCK_CELLS` rows, and each block gives one partial
sum per pair of sources that meet in it. Results are one row per pair of sources,
as they have to be; no pair of terms or documents is ever made.

Counting: a task counts the terms of a block of texts by (lang, source, term) with
the number of documents, before anything is shuffled; a hot source is thereby
combined on the map side. Counts are exact: terms are compared as strings, and
products are decimals.

Edge cases: null text, lang and source are ''; a group without terms has N = 0 and
is listed, and its items are the shares z; without kept terms (V = 0) pairs have
value 0 and there are no terms; a lang with one source has no pairs; repeated rows
count as rows; an empty table gives no rows. Other columns are not read. Texts of
any length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm import common
from frostline.llm.rows import partial_rows

LEAST_DOCUMENTS = 30
TOP = 50
BLOCK_CELLS = 4096

_FOLD = np.array([x + 32 if 0x41 <= x <= 0x5A else x for x in range(256)], np.uint8)
_IS_WORD = np.array([0x61 <= x <= 0x7A or x >= 0x80 for x in range(256)])


def _terms(words: common.Words) -> pa.DictionaryArray:
    """The words as dictionary-encoded strings."""
    lengths = words.ends - words.starts
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    data = words.raw[_IS_WORD[words.raw]]
    return pa.Array.from_buffers(
        pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    ).dictionary_encode()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, documents) of every block of texts."""
    for batch in batches:
        for block in common.text_blocks(batch):
            words = common.Words(block.column("text"), _IS_WORD, _FOLD)
            terms = _terms(words)
            size = len(terms.dictionary)
            if not size:
                continue
            langs, sources = (block.column(x).dictionary_encode() for x in ("lang", "source"))
            width = len(sources.dictionary)
            group = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
            document = np.repeat(np.arange(block.num_rows), words.last - words.first)
            own, times = np.unique(document * size + terms.indices.to_numpy(), return_counts=True)
            cells, at, documents = np.unique(
                group[own // size] * size + own % size, return_inverse=True, return_counts=True
            )
            counts = np.zeros(len(cells), np.int64)
            np.add.at(counts, at, times)
            of = cells // size
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(of // width)),
                    sources.dictionary.take(pa.array(of % width)),
                    terms.dictionary.take(pa.array(cells % size)).cast(pa.string()),
                    pa.array(counts),
                    pa.array(documents.astype(np.int64)),
                ],
                names=["lang", "source", "term", "count", "documents"],
            )


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source", "text")))


def kept_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, count, lang_count, lead) of the terms that at least
    so many documents of the lang hold, where a group holds them; lead marks one
    row of each term of a lang."""
    schema = "lang string, source string, term string, count long, documents long"
    cells = partial_rows(_named(docs), ["lang", "source", "text"], schema, _counted)
    cells = cells.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))
    by_term = Window.partitionBy("lang", "term")
    cells = cells.withColumns(
        {
            "lang_documents": F.sum("documents").over(by_term),
            "lang_count": F.sum("count").over(by_term),
            "lead": F.col("source") == F.min("source").over(by_term),
        }
    )
    kept = cells.filter(F.col("lang_documents") >= least_documents)
    return kept.select("lang", "source", "term", "count", "lang_count", "lead")


def share(count: Column | int, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), null without terms."""
    count = F.lit(count) if isinstance(count, int) else count
    above = (count + 5).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    below = (F.col(total) + 5 * F.col(terms)).cast("decimal(20,0)")
    return F.when(F.col(terms) > 0, 1 + F.call_function("div", above, below))


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every occurring group: lang, source, n, v (kept terms of the lang), lang_n,
    lang_cells (rows of `kept`), z (share of a term that the group lacks)."""
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    langs = kept.groupBy("lang").agg(
        F.count_if("lead").alias("v"),
        F.sum(F.when(F.col("lead"), F.col("lang_count")).otherwise(0)).alias("lang_n"),
        F.count("*").alias("lang_cells"),
    )
    groups = _named(docs.withColumn("text", F.lit(""))).select("lang", "source").distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["n", "v", "lang_n", "lang_cells"])
    return groups.withColumn("z", share(0, "n", "v"))


def leading_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of the terms that are most overused in
    a group against its lang."""
    cells = kept.groupBy("lang", "source", "count", "lang_count").agg(F.count("*").alias("terms"))
    cells = cells.join(groups, ["lang", "source"])
    value = share(F.col("count"), "n", "v") - share(F.col("lang_count"), "lang_n", "v")
    cells = common.written(
        cells.select("lang", "source", "count", "lang_count", "terms", value.alias("value")).filter("value > 0"), "count-cells"
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    # each value has a term or more, so at most `top` values are ranked on
    values = values.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)
    before = F.coalesce(F.sum("terms").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).filter(F.col("before") < top)
    values = values.select("lang", "source", "value", "before")
    chosen = cells.join(values, ["lang", "source", "value"]).select("lang", "source", "count", "lang_count", "value", "before")
    terms = kept.join(chosen, ["lang", "source", "count", "lang_count"])
    among = F.row_number().over(Window.partitionBy("lang", "source", "value").orderBy("term"))
    terms = terms.withColumn("among", among).filter(F.col("among") <= top)
    terms = terms.withColumn("rank", (F.col("before") + F.col("among")).cast("int")).filter(F.col("rank") <= top)
    return terms.select("lang", "source", F.col("term").alias("item"), "value", "rank")


def _absent_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, of, other, value): for each two sources of a lang, the sum over all
    kept terms of |z of `of` - p of `other`|."""
    cells = kept.groupBy("lang", "source", "count").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"])
    p = share(F.col("count"), "n", "v")
    cells = cells.select("lang", F.col("source").alias("other"), F.lit(None).cast("string").alias("of"), p.alias("at"), "terms")
    ask = groups.select("lang", F.col("source").alias("of"), F.col("z").alias("at"))
    asked = groups.select(F.col("lang"), F.col("source").alias("other"), "v", F.col("z").alias("lack"))
    # one row per result, as every source is an item of every other
    asked = ask.join(asked, "lang").filter(F.col("of") != F.col("other"))
    rows = cells.withColumns({"v": F.lit(None).cast("long"), "lack": F.lit(None).cast("long")}).unionByName(
        asked.withColumn("terms", F.lit(0).cast("long"))
    )
    own = Window.partitionBy("lang", "other")
    upto = own.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.col("terms") * F.col("at")
    rows = rows.withColumns(
        {
            "low": F.sum("terms").over(upto),
            "low_sum": F.sum(weight).over(upto),
            "all": F.sum("terms").over(own),
            "all_sum": F.sum(weight).over(own),
        }
    ).filter(F.col("of").isNotNull())
    present = F.col("at") * (2 * F.col("low") - F.col("all")) + F.col("all_sum") - 2 * F.col("low_sum")
    absent = (F.col("v") - F.col("all")) * F.abs(F.col("at") - F.col("lack"))
    both = F.when(F.col("of") < F.col("other"), F.col("v") * F.abs(F.col("at") - F.col("lack"))).otherwise(0)
    # a pair meets twice, and what neither has is counted twice
    return rows.select("lang", "of", "other", F.coalesce(present + absent - both, F.lit(0)).alias("value"))


def common_sums(cells: pd.DataFrame) -> pd.DataFrame:
    """Per pair of sources, the sum over the terms that both have of
    |p - p'| - |z - p'| - |p - z'| + |z - z'|. cells: lang, source, term, p, z."""
    cells = cells.sort_values(["term", "source"], kind="stable")
    names, source = np.unique(cells["source"].to_numpy(), return_inverse=True)
    term = pd.factorize(cells["term"])[0]
    p, z = cells["p"].to_numpy(), cells["z"].to_numpy()
    ends = np.searchsorted(term, term, "right")
    found = []
    for one in range(len(names)):
        at = np.flatnonzero(source == one)
        # partners are the later rows of the same term
        size = ends[at] - at - 1
        mine = np.repeat(at, size)
        theirs = np.arange(len(mine)) - np.repeat(np.cumsum(size) - size, size) + mine + 1
        a, b, x, y = p[mine], p[theirs], z[mine], z[theirs]
        value = np.abs(a - b) - np.abs(x - b) - np.abs(a - y) + np.abs(x - y)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, source[theirs], value)
        met = np.unique(source[theirs])
        found.append(pd.DataFrame({"of": names[one], "other": names[met], "value": total[met]}))
    out = pd.concat(found, ignore_index=True)
    out.insert(0, "lang", cells["lang"].iloc[0])
    return out


def source_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): the other sources of the lang by how
    far their shares are."""
    rated = kept.join(groups, ["lang", "source"])
    blocks = F.ceil(F.col("lang_cells") / BLOCK_CELLS)
    rated = rated.select(
        "lang",
        "source",
        "term",
        share(F.col("count"), "n", "v").alias("p"),
        "z",
        F.pmod(F.xxhash64("term"), blocks).alias("block"),
    )
    met = rated.groupBy("lang", "block").applyInPandas(common_sums, "lang string, of string, other string, value long")
    sums = _absent_sums(kept, groups).unionByName(met)
    sums = sums.groupBy("lang", F.least("of", "other").alias("a"), F.greatest("of", "other").alias("b"))
    sums = sums.agg(F.sum("value").alias("value"))
    ways = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
    )
    sums = sums.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.*", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.withColumn("rank", rank)


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank. docs: text,
    lang, source."""
    kept = common.written(kept_counts(docs, least_documents), "kept-counts")
    groups = common.written(group_sizes(docs, kept), "groups")
    pairs = source_distances(kept, groups).withColumn("part", F.lit("pair"))
    terms = leading_terms(kept, groups, top).withColumn("part", F.lit("term"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*columns).unionByName(terms.select(*columns))
