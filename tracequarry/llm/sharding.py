"""Sharding by sampled splitters, with DataFrame functions alone.

Records are ordered by a hash of their text. Key samples are drawn with a chance in proportion to
the record's size; quantiles of the samples are the splitters, a table that each record's key is
looked up in by its first bits. A range that turns out overfull, and a group of equal texts larger
than a range, is subdivided: ranges by another hash of the text, groups by a hash of the row. So a
range has at most about twice its share of bytes and of rows, and the number of ranges grows with
the input. Sums within the ranges and of all ranges before them place each record on a line of
bytes, which is cut into shards of nearly equal size (law ``bytes``).

Groups of equal texts: the law comes first. A group of at most ``whole_group`` of a shard goes to
the shard that its middle lies in, so a shard is off its share by no more than that; a larger group
is cut where a shard ends, and nowhere else.

Defined cases: a null text has no bytes, size 1 and crc 0; a null doc_id is kept; repeated rows are
rows of their own, told apart by their place in the table; very long texts are hashed and measured
where they are read, and never shuffled; an empty table gives an empty result; other columns are not
read. Texts are equal if two hashes of them and their length are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import need, stash

#: Rows and bytes of text of a range on average; ranges at most (what is broadcast has a few rows a range); key samples a range.
RANGE_ROWS, RANGE_BYTES, RANGES_MOST, SAMPLES = 500_000, 4 << 30, 1 << 16, 32


def chance(*columns) -> Column:
    """A number in [0, 1) by a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def splitters_of(keys: DataFrame, total: int, ranges: int) -> DataFrame:
    """mark: distinct hashes at the quantiles of about SAMPLES * ranges size-weighted samples."""
    drawn = keys.where(chance("h", "row", F.lit(1)) < F.col("size") * F.lit(SAMPLES * ranges / max(total, 1))).select("h")
    # Bounded: SAMPLES * RANGES_MOST hashes in expectation, whatever the input.
    placed = drawn.withColumn("place", F.row_number().over(W.orderBy("h")))
    return placed.where(F.col("place") % SAMPLES == 0).select(F.col("h").alias("mark")).distinct()


def lookup_table(splitters: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """prefix, base, marks: for each value of a hash's first bits the splitters with these bits, and how many come before them; and the number of bits."""
    bits = max(1, math.ceil(math.log2(ranges)) + 1)
    marks = splitters.groupBy(F.shiftright("mark", 64 - bits).alias("prefix")).agg(F.sort_array(F.collect_list("mark")).alias("marks"))
    every = splitters.sparkSession.range(-(1 << bits - 1), 1 << bits - 1).select(F.col("id").alias("prefix"))
    before = F.sum(F.coalesce(F.size("marks"), F.lit(0))).over(W.orderBy("prefix").rowsBetween(W.unboundedPreceding, -1))
    held = every.join(marks, "prefix", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<bigint>")))
    return held.withColumn("base", F.coalesce(before, F.lit(0)).cast("int")), bits


def placed_in_ranges(keys: DataFrame, total: int, rows: int, ranges: int) -> DataFrame:
    """``keys`` with part and sub, which name the range."""
    table, bits = lookup_table(stash(splitters_of(keys, total, ranges), "splitters"), ranges)
    most_bytes, most_rows = 2 * -(-total // ranges), 2 * -(-rows // ranges)

    def cuts(by_bytes: str, by_rows: str) -> Column:
        return F.greatest(F.ceil(2 * F.col(by_bytes) / F.lit(most_bytes)), F.ceil(2 * F.col(by_rows) / F.lit(most_rows))).cast("int")

    full = (F.col("bytes") > most_bytes) | (F.col("rows") > most_rows)
    sums = [F.sum("size").alias("bytes"), F.count("*").alias("rows")]
    # Fewer than 2 * ranges groups can be larger than a range, and fewer ranges overfull.
    large = keys.groupBy("h").agg(*sums).where(full).select("h", cuts("bytes", "rows").alias("row_cuts"))
    number = F.col("base") + F.size(F.filter("marks", lambda m: m <= F.col("h")))
    # A large group is a part of its own behind all others.
    group = F.row_number().over(W.orderBy("h")) + F.lit(ranges)
    large = stash(large.withColumn("group", group), "large-groups")
    placed = keys.withColumn("prefix", F.shiftright("h", 64 - bits)).join(F.broadcast(table), "prefix").join(F.broadcast(large), "h", "left")
    placed = stash(placed.select(*keys.columns, F.coalesce("group", number).alias("part"), F.coalesce("row_cuts", F.lit(0)).alias("row_cuts")), "shard-parts")
    overfull = placed.where("row_cuts = 0").groupBy("part").agg(*sums).where(full).select("part", cuts("bytes", "rows").alias("text_cuts"))
    sub = F.when(F.col("row_cuts") > 0, F.pmod(F.xxhash64("row"), F.col("row_cuts"))).when(F.col("text_cuts") > 0, F.pmod(F.xxhash64("h"), F.col("text_cuts"))).otherwise(0)
    return placed.join(F.broadcast(overfull), "part", "left").select(*keys.columns, "part", sub.cast("int").alias("sub"))


def shard_documents(docs: DataFrame, shards: int = 16, ranges: int | None = None, whole_group: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't ``key``). ``ranges``: None, as many as the input needs."""
    need(docs, "doc_id", "text")
    text = F.col("text").cast("string")
    keys = stash(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-keys",
    )
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = ranges or int(min(RANGES_MOST, max(16, rows // RANGE_ROWS, total // RANGE_BYTES)))
    ranged = stash(placed_in_ranges(keys, total, rows, ranges), "shard-ranges")
    # A few rows a range: sums of all ranges before.
    sums = ranged.groupBy("part", "sub").agg(F.sum("size").alias("bytes"))
    before = F.sum("bytes").over(W.orderBy("part", "sub").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0))).drop("bytes")
    order = W.partitionBy("part", "sub").orderBy("h", "text_crc32", "size", "row")
    group = W.partitionBy("part", "sub", "h", "text_crc32", "size")
    placed = (
        ranged.withColumn("ends", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("group_from", F.min(F.col("ends") - F.col("size")).over(group))
        .withColumn("group_to", F.max("ends").over(group))
        .join(F.broadcast(sums), ["part", "sub"])
    )
    share = max(1, total) / shards
    whole = F.col("group_to") - F.col("group_from") <= F.lit(whole_group * share)
    middle = F.col("before") + F.when(whole, (F.col("group_from") + F.col("group_to")) / 2).otherwise(F.col("ends") - F.col("size") / 2)
    placed = stash(
        placed.select("doc_id", "size", "text_crc32", "h", "row", "part", "sub", F.least(F.lit(shards - 1), F.floor(middle / F.lit(share))).cast("int").alias("shard")),
        "shard-places",
    )
    counts = placed.groupBy("shard", "part", "sub").agg(F.count("*").alias("rows"))
    earlier = F.sum("rows").over(W.partitionBy("shard").orderBy("part", "sub").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumn("earlier", F.coalesce(earlier, F.lit(0))).drop("rows")
    within = F.row_number().over(W.partitionBy("part", "sub", "shard").orderBy("h", "text_crc32", "size", "row"))
    return placed.withColumn("within", within).join(F.broadcast(counts), ["shard", "part", "sub"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("earlier") + F.col("within") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
