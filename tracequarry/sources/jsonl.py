"""Newline-delimited JSON as a dynamic log table: _pos, _ts, raw and v (VARIANT).

_pos orders the lines. For files it is a struct of file, block offset and a number that rises in
the block, so no pass over the data is needed to number the lines.
"""

from __future__ import annotations

import zlib
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.resolver import VariantResolver

#: RFC 3339 with date, time, seconds and zone. Fixed value.
RFC3339 = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
PREVIEW = 80


class MalformedLine(ValueError):
    """A line isn't valid JSON, and the read is strict."""


def timestamp_of(text: Column) -> Column:
    """UTC time of an RFC 3339 text; null for anything else."""
    shape = F.regexp_replace(F.upper(text), "^(.{19})(\\.\\d{1,6})?\\d*", "$1$2")
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(shape))


def once(value: Column) -> Column:
    """The same value, computed where it stands: the optimizer moves no copy of it into filters above."""
    return F.when(F.spark_partition_id() >= 0, value)


@contextmanager
def duplicate_keys(spark: SparkSession):
    """Parsing made inside takes objects with repeated keys; the session's setting is put back after."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")  # read when an expression is made
    try:
        yield
    finally:
        spark.conf.set(name, before)


def listed(line: Column) -> Column:
    """VARIANT of a list: the line's value, and a number of the line's own behind it; null if that is no JSON.

    The parser stops after the first value, so the number is in its place only if the line is one value.
    """
    return F.try_parse_json(F.concat(F.lit("["), line, F.lit(","), F.xxhash64(line).cast("string"), F.lit("]")))


def whole(pair: Column, line: Column) -> Column:
    """Whether a line with that list is one JSON value."""
    return F.coalesce(F.try_variant_get(pair, "$[1]", "bigint") == F.xxhash64(line), F.lit(False))


def decoded(lines: DataFrame, time_field: str | None = None) -> DataFrame:
    """From _pos and value (a line without its line feed) to _pos, _ts, raw and v; v is null if malformed.

    Of duplicate keys the last one counts.
    """
    raw = F.regexp_replace("value", "\r$", "")
    with duplicate_keys(lines.sparkSession):
        rows = lines.select("_pos", raw.alias("raw")).select("_pos", "raw", once(listed(F.col("raw"))).alias("pair"))
        rows = rows.select("_pos", "raw", once(F.when(whole(F.col("pair"), F.col("raw")), F.try_variant_get("pair", "$[0]", "variant"))).alias("v"))
    at = F.lit(None).cast("timestamp")
    if time_field:
        found = VariantResolver("v").entry(time_field)
        text = F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))
        at = timestamp_of(text)
    return rows.select("_pos", at.alias("_ts"), "raw", "v")


def read_jsonl(spark: SparkSession, path: str, time_field: str | None = None, strict: bool = False) -> DataFrame:
    """The complete lines of a file, in order; an unterminated last line is left out.

    Strict: the first malformed line raises ``MalformedLine``. Else such lines are skipped.
    Duplicate keys: the last one counts.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    # Ids rise within a file's block and blocks have their offsets, so both give the order of lines.
    rows = lines.select(F.struct("file", "block", "id").alias("_pos"), "value")
    torn = torn_files(spark, path)
    if torn:
        last = rows.where(F.col("_pos.file").isin(torn)).groupBy("_pos.file").agg(F.max("_pos").alias("_pos")).select("_pos")
        rows = rows.join(F.broadcast(last), "_pos", "left_anti")  # one row a file
    found = decoded(rows, time_field)
    if strict:
        bad = found.where("v IS NULL").orderBy("_pos").limit(1).collect()
        if bad:
            at = bad[0]["_pos"]
            upto = F.struct(F.lit(at.file).alias("file"), F.lit(at.block).cast("long").alias("block"), F.lit(at.id).cast("long").alias("id"))
            number = found.where(F.col("_pos") <= upto).count()
            raise MalformedLine(f"line {number} is not valid JSON\n  {bad[0].raw[:PREVIEW]}")
    return found.where("v IS NOT NULL")


def torn_files(spark: SparkSession, path: str) -> list[str]:
    """Files that don't end with a line feed, read through Spark's own file systems: the last byte alone."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(conf)
    found = []
    for status in system.globStatus(at) or []:
        inside = list(system.listStatus(status.getPath())) if status.isDirectory() else [status]
        for file in inside:
            if not file.isDirectory() and file.getLen():
                stream = system.open(file.getPath())
                stream.seek(file.getLen() - 1)
                if stream.read() != 10:
                    found.append(file.getPath().toUri().toString())
                stream.close()
    return [f if not f.startswith("file:/") or f.startswith("file:///") else "file://" + f[5:] for f in found]


def data_dir(path: str, base: str | None = None) -> str:
    """The folder of a log's durable state: by the crc32 of its whole path."""
    root = Path(base) if base else Path.home() / ".local" / "share" / "tracequarry"
    return str(root / str(zlib.crc32(str(Path(path).resolve()).encode())))
