"""Packing of documents into sequences along a space-filling curve.

Each text becomes a hashed vector of its byte four-grams; a random projection takes that to
three dimensions, whose quantised values give a Hilbert key. Documents are range-sorted by that
key, and each range is one stream of ids that is cut every ``length`` ids. What is left at a
range's end is cut into powers of two, so no sequence needs padding.

Defined cases: a null text counts as empty and has the end id alone; a null doc_id is kept;
repeated rows are packed as often as they occur, ordered by key, doc_id and their place in the table,
so a hot key or id is dealt to several ranges; a very long text is encoded in parts and its pieces go
out with its batch; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, need, slices, text_buffer
from .token_store import list_crcs, with_end
from .word_codec import library_codec

DIMENSIONS, BITS, BUCKETS = 3, 10, 1 << 14
_SIGNS = ((mix64(np.arange(DIMENSIONS * BUCKETS, dtype=np.uint64) + np.uint64(7)) & np.uint64(1)).astype(np.int8) * 2 - 1).reshape(DIMENSIONS, BUCKETS)
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer cells (rows, dimensions), by Skilling's transform."""
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for d in range(len(x)):
            high = (x[d] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if d:
                x[d] ^= swap
        q >>= 1
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for part in x:
            key = key << 1 | ((part ^ turn) >> b & 1)
    return key


def curve_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The Hilbert key of each row's hashed and projected text; windows stay within a row."""
    sizes = np.diff(offsets)
    cells = np.full((len(sizes), DIMENSIONS), 1 << (BITS - 1), np.int64)
    full = np.flatnonzero(sizes >= 4)
    if len(full):
        wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        grams = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
        buckets = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
        # Windows that reach into the next row belong to none.
        inside = np.ones(len(data), np.int8)
        for back in (1, 2, 3):
            at = offsets[1:] - back
            inside[at[at >= 0]] = 0
        for d in range(DIMENSIONS):
            sums = np.concatenate([[0], np.cumsum(_SIGNS[d][buckets] * inside, dtype=np.int64)])
            value = (sums[offsets[1:]] - sums[offsets[:-1]])[full] / np.sqrt(sizes[full])
            cells[full, d] = np.clip((value / 16 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells, BITS)


@F.arrow_udf(T.LongType())
def curve_key(text: pa.Array) -> pa.Array:
    out = []
    for part in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text"):
        out.append(curve_keys(*text_buffer(part.column("text"))))
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))


def cuts(first: int, counts: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the pieces when rows of ``counts`` ids from position ``first`` are cut at ``marks``."""
    ends = first + np.cumsum(counts)
    total = int(ends[-1])
    edges = np.unique(np.concatenate([[first], ends, marks[(marks > first) & (marks < total)]]))
    return np.searchsorted(ends, edges[:-1], side="right"), edges[:-1], edges[1:]


def binary_marks(first: int, size: int) -> np.ndarray:
    """Where ``size`` ids from ``first`` are cut so that all parts are powers of two, largest first."""
    out, at = [first], first
    for bit in range(size.bit_length() - 1, -1, -1):
        if size >> bit & 1:
            at += 1 << bit
            out.append(at)
    return np.array(out, np.int64)


def packed(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, length: int, encode_special_tokens: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of one range; what the open sequence holds waits until that is full or the range ends."""
    codec, range_id = library_codec(tokenizer_path, encode_special_tokens), TaskContext.get().partitionId()
    sequence = 0  # number of the open sequence
    # Of the rows that reach into the open sequence: id, ids so far placed, ids of the whole row, ids to place.
    rows, placed, whole, ids = np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    waiting = np.zeros(0, np.int64)

    def emit(row, begin, end, number, offset):
        starts = np.concatenate([[0], np.cumsum(waiting)])[row]
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, end[-1:]).astype(np.int32)), pa.array(ids))
        columns = [pa.array(rows[row].tolist(), pa.int64()), pa.array(placed[row] + begin - starts), pa.array(end - begin), pa.array(whole[row]), pa.array((range_id << 32) + number), pa.array(offset), lists]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    for batch in batches:
        for part in slices(batch, "text"):
            more, counts = with_end(*codec.encode(*text_buffer(part.column("text"))), end_id)
            rows = np.concatenate([rows, np.array(part.column("doc_id").to_pylist(), object)])
            placed, whole = np.concatenate([placed, np.zeros(len(counts), np.int64)]), np.concatenate([whole, counts])
            waiting, ids = np.concatenate([waiting, counts]), np.concatenate([ids, more])
            full = len(ids) // length * length
            if not full:
                continue
            row, begin, end = cuts(0, waiting, np.arange(0, full + 1, length))
            done = end <= full
            yield emit(row[done], begin[done], end[done], sequence + begin[done] // length, begin[done] % length)
            sequence += full // length
            ends = np.cumsum(waiting)
            left = ends > full
            taken = np.minimum(waiting, np.maximum(0, full - (ends - waiting)))
            rows, placed, whole, waiting, ids = rows[left], (placed + taken)[left], whole[left], (waiting - taken)[left], ids[full:]
    if len(ids):
        marks = binary_marks(0, len(ids))
        row, begin, end = cuts(0, waiting, marks)
        of = np.searchsorted(marks, begin, side="right") - 1
        yield emit(row, begin, end, sequence + of, begin - marks[of])


def in_curve_order(docs: DataFrame) -> DataFrame:
    """doc_id and text, range-sorted along the curve; equal keys are parted by doc_id."""
    need(docs, "doc_id", "text")
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    rows = rows.withColumns({"curve": curve_key(F.coalesce("text", F.lit(""))), "place": F.monotonically_increasing_id()})
    return rows.repartitionByRange("curve", "doc_id", "place").sortWithinPartitions("curve", "doc_id", "place").select("doc_id", "text")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = 1024, encode_special_tokens: bool = True) -> DataFrame:
    """The pieces with their ids; ``encode_special_tokens`` as in ``library_codec``."""
    return in_curve_order(docs).mapInArrow(lambda batches: packed(batches, tokenizer_path, end_id, length, encode_special_tokens), PIECE)


def pack_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = 1024, encode_special_tokens: bool = True) -> DataFrame:
    """The same pieces with ids_crc32 in place of their ids."""
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in packed(batches, tokenizer_path, end_id, length, encode_special_tokens):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(list_crcs(batch.column("ids")))], [*names, "ids_crc32"])

    schema = ", ".join(f"{c} long" for c in [*names, "ids_crc32"])
    return in_curve_order(docs).mapInArrow(run, schema)
