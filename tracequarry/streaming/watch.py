"""Durable ingestion of a growing log, and live queries on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.limits import retained
from ..session import LogTable
from ..sources.jsonl import data_dir, decoded, duplicate_keys, listed, read_jsonl, whole
from ..sources.logtail import read_tail


class Watch:
    """Tails ``path`` into a Parquet table of _pos, value and valid; the checkpoint makes restarts exact.

    ``state``: a folder for table and checkpoint (on a cluster: a shared one). ``every``: trigger
    interval; None takes all that the file holds at the start, in as many micro-batches as that needs,
    and stops. ``strict`` validates the file's lines first. State that can't be read (a broken
    checkpoint, a lost Parquet file) raises Spark's error at the start or in the query; nothing is
    thrown away or begun anew by itself. A checkpoint's range that is gone from the log raises too.
    """

    def __init__(self, spark: SparkSession, path: str, time_field: str | None = None, state: str | None = None, every: str | None = "1 second", max_events: int | None = 2_000_000, strict: bool = False, max_bytes: int = 16 << 20):
        self.max_bytes = max_bytes
        self.spark, self.time_field, self.every, self.max_events, self.base = spark, time_field, every, max_events, state
        self._start(path, strict)

    def _start(self, path: str, strict: bool) -> None:
        if strict:
            read_jsonl(self.spark, path, self.time_field, strict=True)
        self.path, self.state = path, data_dir(path, self.base)
        lines = read_tail(self.spark, path, max_bytes=self.max_bytes, to_end=not self.every)
        # Whether a line is valid is told once, here; so retention counts rows without parsing them.
        raw = F.regexp_replace("value", "\r$", "")
        with duplicate_keys(self.spark):
            lines = lines.withColumn("valid", whole(listed(raw), raw))
        writer = lines.writeStream.format("parquet").option("path", f"{self.state}/lines").option("checkpointLocation", f"{self.state}/checkpoint")
        # A source without an end of its own runs one batch a trigger; so the run goes on until nothing is left.
        self.running: StreamingQuery = writer.trigger(processingTime=self.every or "0 seconds").start()
        if not self.every:
            try:
                self.running.processAllAvailable()
            finally:
                self.running.stop()

    def table(self) -> LogTable:
        """All that is committed, malformed lines left out; the newest ``max_events`` count (None: all)."""
        lines = self.spark.read.schema("_pos long, value string, valid boolean").parquet(f"{self.state}/lines").where("valid")
        kept = lines if self.max_events is None else retained(lines, self.max_events, ("_pos",))
        return LogTable(decoded(kept, self.time_field), self.time_field)

    def query(self, text: str) -> DataFrame:
        return self.table().query(text)

    def answer(self, text: str) -> str:
        return self.table().answer(text)

    def rewatch(self, path: str, time_field: str | None = None) -> None:
        """Goes over to another file, with a state of its own."""
        self.stop()
        self.time_field = time_field
        self._start(path, strict=False)

    def stop(self) -> None:
        if self.running.isActive:
            self.running.processAllAvailable()
            self.running.stop()


def follow(spark: SparkSession, path: str, text: str, each: Callable[[DataFrame, int], None], time_field: str | None = None, start: str = "latest", checkpoint: str | None = None, every: str = "1 second") -> StreamingQuery:
    """Calls ``each`` with the matching new rows (_pos, _ts, raw, v) of every micro-batch. Relative times are fixed now."""
    rows = decoded(read_tail(spark, path, start), time_field).where("v IS NOT NULL")
    writer = LogTable(rows, time_field).follow(text).writeStream.foreachBatch(each).trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
