"""The queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_documents, hamming, lang_id, ngram_join, nn_descent, packing, sharding, token_counts, token_store, toxicity
from .common import read_table, shared_dir

RANKS, LIBRARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"

#: Shingle sets, links by shared shingles, and the smallest document that links reach.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents
LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x) USING (doc_id)
"""

#: All pairs of sign codes.
NEAREST_CODES = """
WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(len(list_filter(range(1, len(q.bits) + 1), lambda i: q.bits[i] <> c.bits[i])) AS INTEGER) AS distance
  FROM codes q JOIN codes c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.top_k(read_table(spark, sf_dir, "embeddings"), 5, "vec_id", "embedding", F.col("id") % 50 == 0)


def op3_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming.sign_codes(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return hamming.top_k(codes, 10, F.col("id") % 50 == 0)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_documents.encode_decode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    token_store.write_store(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path(LIBRARY), end_id=2, encode_special_tokens=False)
    return token_store.store_digests(token_store.read_store(spark, path))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = lang_id.identify(docs.select("doc_id", "text", lang_id.held_out().alias("held_out")), lang_id.fit(docs), keep=("held_out",))
    return found.select("doc_id", "held_out", "lang_pred", "score", "spans")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(LIBRARY), end_id=0, length=1024, encode_special_tokens=False)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=16)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    found = toxicity.score(docs.select("doc_id", "text", lang_id.held_out().alias("held_out")), model, keep=("held_out",))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic_spans")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(LIBRARY), encode_special_tokens=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_nn_descent, op3_hamming, op4_bpe, op5_token_store, op6_language, op7_packing, op8_sharding, op9_toxicity, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": NEAR_DUPLICATES, "op3_hamming": NEAREST_CODES}
