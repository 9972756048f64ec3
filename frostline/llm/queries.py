"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import (
    chat,
    common,
    decontaminate,
    divergence,
    filter_audit,
    html_text,
    jaccard,
    language,
    packing,
    quality,
    shards,
    token_codes,
    toxicity,
    url_filter,
)
from frostline.llm.oracle import SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-codes")
    token_codes.write_codes(_table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", 2)
    return token_codes.read_documents(spark, path)


def _hash_of_id(modulus: int):
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    path = common.new_path(spark, "chats")
    formatted = chat.format_conversations(turns)
    formatted.write.parquet(path)
    back = chat.read_back(spark.read.schema(formatted.schema).parquet(path))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("max_level").alias("escape_level"),
    )


def op3_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_hash_of_id(5) == 0, F.lit(False))
    prototypes = language.learn(docs.filter(_hash_of_id(5) != 0))
    found = language.predict(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.learn(pages))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(_table(spark, sf_dir, "documents"), percent=85, size=4)


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "shards")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    shards.shard(docs, 24, path)
    back = spark.read.schema("record struct<doc_id: long, text: string>, slot long, shard int").parquet(path)
    text = F.col("record.text")
    return back.select(
        F.col("record.doc_id").alias("doc_id"),
        shards.size_of(text).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_hash_of_id(4) == 2, F.lit(False))
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels").filter(_hash_of_id(4) != 2))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.TOXIC_FROM, 1).otherwise(0).alias("predicted"),
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 0, 2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn_rules(docs, _table(spark, sf_dir, "labels"))
    judged = quality.judge(docs, rules)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return judged.select("doc_id", *(f"statistics.{x}" for x in columns))


def op11_filter_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_count_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees learn from the urls that a rule has judged."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judged_by_rules(pages, url_filter.RULES)
    model = url_filter.learn(judged.select("url", F.col("rule.verdict").alias("verdict")))
    found = url_filter.judge(pages, url_filter.RULES, model)
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_codes": op1_token_codes,
    "op2_chat_format": op2_chat_format,
    "op3_language_profiles": op3_language_profiles,
    "op4_decontaminate": op4_decontaminate,
    "op5_block_labeller": op5_block_labeller,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_external_shuffle": op7_external_shuffle,
    "op8_compression_distance": op8_compression_distance,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_decision_lists": op10_decision_lists,
    "op11_filter_potentials": op11_filter_potentials,
    "op12_count_cells": op12_count_cells,
    "op13_url_trees": op13_url_trees,
    "pipeline": pipeline,
}
