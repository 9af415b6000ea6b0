"""A corpus from raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipstride.llm import near_dedup as near_copies
from clipstride.llm import packing, quality_ranking, quality_rules, substring_dedup
from clipstride.operators.store import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the current policy of the rules keeps."""
    return quality_rules.kept(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the ranking learned from the labelled documents puts above its threshold."""
    model = quality_ranking.train(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_ranking.scored(docs, model, "__score").where("__score >= 0.5").drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest doc_id of each component of near copies (five-word similarity of 0.8 or more)."""
    return near_copies.one_of_each(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that repeat; ``n_chars`` follows the text."""
    rest = substring_dedup.rewritten(docs)
    return rest.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rest


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("quality_rules", quality),
    ("quality_classifier", classifier),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("packing", pack),
]

#: SQL cannot express the learned scores, XXH64 fingerprints or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
