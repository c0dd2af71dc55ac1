"""Byte-level BPE encoding and decoding of documents by the transducer of ``bpe_fst``.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to the empty
text; a very long text is encoded in parts and decoded 65,536 ids at a time; a null id stays null; repeated rows give repeated results; an empty table gives an empty
result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_fst import vocabulary
from .common import need, slices, text_buffer


def encoded(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(row ids, token ids of all rows, tokens of each row) for about 1 MB of text at a time."""
    codec = vocabulary(ranks_path).codec
    for batch in batches:
        for part in slices(batch, "text"):
            ids, counts = codec.encode(*text_buffer(part.column("text")))
            yield part.column("doc_id"), ids, counts


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    need(docs, id_col, text_col)

    def run(batches):
        for rows, ids, counts in encoded(batches, ranks_path):
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded_docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give an empty text."""

    def run(batches):
        vocab = vocabulary(ranks_path)
        for batch in batches:
            column = batch.column("ids")
            texts = ["".join(vocab.decode(np.asarray(ids.values if ids.is_valid else [], np.int64))) for ids in column]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_decode_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each row is encoded, its ids are decoded again."""
    need(docs, "doc_id", "text")

    def run(batches):
        vocab = vocabulary(ranks_path)
        decimal = vocab.decimal.__getitem__
        for rows, ids, counts in encoded(batches, ranks_path):
            of_ids, of_text = [], []
            ends = np.cumsum(counts)
            for a, b in zip((ends - counts).tolist(), ends.tolist()):
                own = ids[a:b]
                of_ids.append(hashlib.sha256(" ".join(map(decimal, own.tolist())).encode()).hexdigest())
                digest = hashlib.sha256()
                for text in vocab.decode(own):
                    digest.update(text.encode())
                of_text.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([rows, pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
