"""Token ids in Parquet: one list column, ordered by document, readable by columns and by pages.

Layout of a store: data files in ascending document order with the columns doc_id, shard,
local_start (ids of the shard before the document), n_tokens and tokens; beside them, in
``_manifest``, the ids of each shard and of all shards before it. Row groups, pages and the
encoding of the ids (dictionary, or delta with version 2 pages) are parameters. Parquet's page
index is always written, so a range of documents reads only its pages, and a read of metadata
columns never touches the ids.

Defined cases: a null text counts as empty and has the end id alone; a null doc_id is kept and
comes first; rows that repeat a doc_id are ordered by the first characters of their text, then by
their place in the table, so even a third of all rows with one id is dealt to several shards; a very
long text is encoded in parts, and its ids are one list (of fewer than 2**31); an empty table gives
an empty store; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import need, slices, text_buffer
from .word_codec import library_codec

COLUMNS = "doc_id long, shard int, local_start long, n_tokens int, tokens array<int>"


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each row's."""
    counts = counts + 1
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    out[ends - 1] = end_id
    body = np.ones(len(out), bool)
    body[ends - 1] = False
    out[body] = ids
    return out, counts


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, encode_special_tokens: bool = True) -> None:
    """Encode ``docs`` (doc_id, text) into a store at ``path``; ``encode_special_tokens`` as in ``library_codec``."""
    need(docs, "doc_id", "text")
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding: dictionary or delta")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, shard, total = library_codec(tokenizer_path, encode_special_tokens), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = with_end(*codec.encode(*text_buffer(part.column("text"))), end_id)
                ends = np.cumsum(counts)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.full(len(counts), shard, np.int32)), pa.array(total + ends - counts), pa.array(counts.astype(np.int32)), tokens],
                    ["doc_id", "shard", "local_start", "n_tokens", "tokens"],
                )
                total += int(ends[-1])

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    rows = rows.withColumns({"head": F.substring("text", 1, 16), "place": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "head", "place"]
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(run, COLUMNS)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0")
        .parquet(path)
    )
    # One row a shard: their number is that of the files.
    shards = docs.sparkSession.read.schema(COLUMNS).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = F.sum("shard_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    shards.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")


def read_store(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, unless ``tokens`` is false, tokens."""
    data = spark.read.schema(COLUMNS).parquet(path)
    manifest = spark.read.schema("shard int, shard_tokens long, before long").parquet(f"{path}/_manifest")
    kept = ["doc_id", (F.col("before") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens")]
    return data.join(manifest.select("shard", "before"), "shard").select(*kept, *(["tokens"] if tokens else []))


def list_crcs(column: pa.ListArray) -> np.ndarray:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    raw = np.asarray(column.values, "<u4").tobytes()
    ends = (np.asarray(column.offsets, np.int64) * 4).tolist()
    return np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])), np.int64, len(column))


def store_digests(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what ``read_store`` returns."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(list_crcs(batch.column("tokens")))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return store.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
