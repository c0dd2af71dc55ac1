"""Helpers shared by the operators: shared-folder tables, Arrow text buffers, digests."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; a longer single text is handled alone.
SLICE_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one of this machine only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + os.path.join(tempfile.gettempdir(), "tracequarry-shared")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(stashed: DataFrame) -> None:
    """Deletes what ``stash`` wrote, once nothing that is still to run reads it."""
    spark = stashed.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stashed.stashed_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of a batch between Spark and a worker. Rows of text are long: 10,000 of them (the default) take tens of MB on both sides.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; of it and of all that is made of it, small batches go to the workers (unless the session says how many)."""
    name_of_rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name_of_rows) == "10000":
        spark.conf.set(name_of_rows, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8) if len(wide) else np.zeros(1, np.int64)
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of the batch, with about ``limit`` bytes of text each."""
    if batch.num_rows == 0:
        return
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(batch.num_rows, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds), vectorised."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Spans longer than this are hashed one by one.
LONG_SPAN = 256
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as an integer, without a copy of each; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time are mixed into the state, all spans in step.

    Spans of one length of at most eight bytes never share a hash.
    """
    size = ends - starts
    out = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    windows = _windows(data)
    at = None  # all spans
    for done in range(0, LONG_SPAN, 8):
        live = np.flatnonzero((size > done) & (size <= LONG_SPAN)) if at is None else at[size[at] > done]
        if not len(live):
            break
        chunk = windows[starts[live] + done] & _TAIL[np.minimum(size[live] - done, 8)]
        out[live] = mix64(out[live] * np.uint64(0xC2B2AE3D27D4EB4F) ^ chunk)
        at = live
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def equal_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes at the places in ``a`` and in ``b`` have the same bytes."""
    left, right, same = _windows(a), _windows(b), np.ones(len(size), bool)
    live, done = np.flatnonzero(size <= LONG_SPAN), 0
    while len(live):
        same[live] &= (left[a_starts[live] + done] ^ right[b_starts[live] + done]) & _TAIL[np.minimum(size[live] - done, 8)] == 0
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        same[i] = np.array_equal(a[a_starts[i] : a_starts[i] + size[i]], b[b_starts[i] : b_starts[i] + size[i]])
    return same


#: ASCII white space that separates words: blank and 0x09-0x0D. Fixed values.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes that aren't white space, never across rows."""
    n = len(data)
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < n]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1] - 1
    edge = edge[edge >= 0]
    last[edge] = inside[edge]
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes kept."""
    return _LOWER[data]


def fold(column, *more) -> F.Column:
    return F.xxhash64(column, *more)
