"""A corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor
kept, and returns a DataFrame; `run` writes it and reads it back for the next
one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import common, decontaminate, jaccard, packing, quality, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned rule go."""
    rules = quality.learn_rules(docs, _labels(spark, sf_dir))
    return quality.judge(docs, rules).filter("statistics.kept").select(*docs.columns)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op8 calls toxic go."""
    labels = _labels(spark, sf_dir)
    model = toxicity.learn(docs, labels.filter(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 != 2))
    scored = toxicity.score(docs, model)
    return scored.filter(F.col("score") < toxicity.TOXIC_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the row with the smallest (doc_id, text) stays, and
    every row without words. Linked at five words and 0.8; four words and 0.85
    are the contract of the query op6."""
    return jaccard.first_of_components(docs, percent=80, size=5)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("n_hit = 0").select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence."""
    packed = packing.pack(docs, "byte_bpe_50k.json", 0, 2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packed_sequences),
]

# learned rules, dictionaries and tokenizers have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = common.written(docs, f"stage-{number}")
    return docs
