"""From documents to packed sequences: language ID, toxicity, near duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm import lang_id, ngram_join, packing, toxicity
from tracequarry.llm.common import read_table, stash

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language: null, or without any letter."""
    docs = docs.select(*DOCUMENTS)
    found = lang_id.identify(docs, lang_id.fit(docs), spans=False, keep=tuple(DOCUMENTS))
    return found.where("lang_pred <> 'und'").select(*DOCUMENTS)


def without_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of 0.3 or more."""
    docs = docs.select(*DOCUMENTS)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, spans=False, keep=tuple(DOCUMENTS)).where("score < 0.3").select(*DOCUMENTS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that of the smallest doc_id, without an id only if none has one.

    Rows equal in doc_id (null or not) and text count as one; texts without words are classes of their own.
    """
    # Ids may be null or stand at several texts, so classes are of rows, by a key of id and text.
    docs = docs.select(*DOCUMENTS).withColumn("key", F.xxhash64("doc_id", "text"))
    classes = ngram_join.near_duplicates(docs.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = docs.select("key", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    kept = classes.join(ids, "key").groupBy("component_id").agg(first).select("first.key")
    return docs.join(kept, "key", "left_semi").dropDuplicates(["key"]).select(*DOCUMENTS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens, near texts beside one another."""
    return packing.pack_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, length=1024, encode_special_tokens=False)


STAGES = [
    ("language", identified_language),
    ("toxicity", without_toxicity),
    ("near_duplicates", one_of_near_duplicates),
    ("packing", packed_sequences),
]

#: The stages use trained models and a tokenizer, which SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
