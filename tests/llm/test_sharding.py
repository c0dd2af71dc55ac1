import random
import zlib

from pyspark.sql import functions as F

from tracequarry.llm import sharding
from tracequarry.llm.sharding import shard_documents


def check(docs, shards, **more):
    rows = docs.collect()
    found = shard_documents(docs, shards, **more).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in found) == sorted((r.doc_id or -1, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    sizes = [0] * shards
    for s in range(shards):
        own = [r for r in found if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sizes[s] = sum(r.size for r in own)
    return found, sizes


def test_bytes_nearly_equal_and_hot_group_split(spark):
    random.seed(1)
    rows = [(i, f"{i % 2900} " + "w" * (i % 2900 % 150), "x") for i in range(3000)] + [(10_000 + i, "copy of a text " * 5, "y") for i in range(1500)] + [(None, None, "z"), (5, "é", None), (5, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(7)
    found, sizes = check(docs, 16, ranges=32)
    mean = sum(sizes) / 16
    assert max(abs(s - mean) for s in sizes) < 0.03 * mean
    shards = {}
    for r in found:
        shards.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 1


def test_few_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string")
    check(docs, 16)
    assert shard_documents(docs.limit(0)).count() == 0


def test_ranges_are_bounded(spark):
    """Against a plain count: no range has much over twice its share, hot groups and null ids included."""
    rows = [(i, "text %d" % i) for i in range(4000)] + [(None, "hot")] * 2000 + [(7, "warm " * 40)] * 300
    keys = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.length("text").cast("long").alias("size"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    total = sum(len(t) for _, t in rows)
    found = sharding.placed_in_ranges(keys, total, len(rows), 40).collect()
    assert sorted(r.row for r in found) == sorted(r.row for r in keys.collect())
    sizes, counts, parts = {}, {}, {}
    for r in found:
        sizes[r.part, r["sub"]] = sizes.get((r.part, r["sub"]), 0) + r.size
        counts[r.part, r["sub"]] = counts.get((r.part, r["sub"]), 0) + 1
        parts.setdefault(r.part, []).append(r.h)
    assert max(sizes.values()) < 3 * total / 40 and max(counts.values()) < 3 * len(rows) / 40 and len(sizes) > 20
    # Ranges follow the order of the hashes.
    ends = [(min(h), max(h)) for p, h in sorted(parts.items()) if p <= 40]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
