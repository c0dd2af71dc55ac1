"""Exact top-k search of binary codes by incremental multi-index hashing.

The code is cut into m segments of about log2(codes) bits. The index is a table of buckets: segment,
its value, and the distinct codes that have it there. Radius by radius, each query that isn't done
probes the buckets whose value differs from its own in exactly that many bits, by a join on segment
and value; what it finds is verified by the whole distance. After radius r every code within
m * (r + 1) - 1 is known, so a query is done once that many verified ids are as near as that. Once
enough ids are found, the distance of the kth bounds what is left: at radius r only so many segments
are probed that every code up to that distance is known, and then the query is done.

A pair of query and code is taken only at its smallest segment distance, and of equal ones at the
first segment, so no pair is verified twice and none has to be remembered. A bucket of many codes is
dealt into cuts, each a key of its own in the join.

A query that is far from all others needs large radii, at most all values of a segment. Memory is
bounded by a cut and by a query's best ids, whatever the tables' and the texts' sizes.

Defined cases: rows with a null id, a null, empty or non-finite vector, or of another dimension
than most take no part; equal codes share their place, and of them the smallest ids count; an id
that stands at several rows is, as a query, each of its codes, with the nearest of them counting,
and as a candidate it is found once, at its nearest code; fewer than k candidates are all returned;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash
from .vectors import matrix, smallest_ids, valid_vectors

#: Codes of a bucket that one key of the join holds.
CUT_CODES = 256
#: Bits of a segment at least and at most.
SEGMENT_BITS = (4, 24)


def sign_codes(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and code (binary): a bit for each component, set if it is positive."""
    rows = valid_vectors(table, id_col, vector_col).withColumn("size", F.size("vector"))
    usual = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    rows = rows.where(F.col("size") == (usual["size"] if usual else 0)).select("id", "vector")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bits = np.packbits(matrix(batch.column("vector")) > 0, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([b.tobytes() for b in bits], pa.binary())], ["id", "code"])

    return rows.mapInArrow(run, "id long, code binary")


def segment_sizes(width: int, codes: int) -> list[int]:
    """Bits of each segment: at most log2(codes), so that few probes meet an empty bucket."""
    bits = int(np.clip(int(math.log2(max(codes, 2))), *SEGMENT_BITS))
    count = max(1, -(-width // bits))
    return [width // count + (i < width % count) for i in range(count)]


def segments(code: Column, sizes: list[int]) -> Column:
    """The segments' values, from the code as text of zeros and ones."""
    at = [sum(sizes[:i]) + 1 for i in range(len(sizes))]
    return F.array(*(F.conv(F.substring(code, a, n), 2, 10).cast("long") for a, n in zip(at, sizes)))


def masks(bits: int, radius: int) -> list[int]:
    """All values of ``bits`` bits with ``radius`` of them set."""
    return [sum(1 << i for i in c) for c in combinations(range(bits), radius)]


def bit_text(code: Column, width: int) -> Column:
    """A binary column of ``width`` bytes as text of zeros and ones."""
    parts = [(i, min(4, width - i)) for i in range(0, width, 4)]
    return F.concat(*(F.lpad(F.conv(F.hex(F.substring(code, i + 1, n)), 16, 2), 8 * n, "0") for i, n in parts))


def bucket_table(distinct: DataFrame) -> DataFrame:
    """segment, value, cut, cuts, codes (array of parts and ids): a bucket's codes, at most about CUT_CODES in a cut."""
    placed = distinct.select("parts", "ids", F.posexplode("parts").alias("segment", "value"))
    held = placed.groupBy("segment", "value").agg(F.ceil(F.count("*") / CUT_CODES).cast("int").alias("cuts"))
    # The planner takes exploded rows for no larger than what they came from: never broadcast them.
    placed = placed.hint("merge").join(held, ["segment", "value"]).withColumn("cut", F.pmod(F.xxhash64("parts"), F.col("cuts")).cast("int"))
    return placed.groupBy("segment", "value", "cut", "cuts").agg(F.collect_list(F.struct("parts", "ids")).alias("codes"))


def probes(active: DataFrame, sizes: list[int], radius: int) -> DataFrame:
    """query, own, bound, segment, value: the buckets at exactly this segment distance."""

    def around(i: int, bits: int) -> Column:
        near = F.array(*(F.lit(m).cast("long") for m in masks(bits, radius)))
        # Codes that aren't known yet differ by radius in each segment at least, by one more in those probed now.
        needed = F.col("bound").isNull() | (F.col("bound") >= radius * len(sizes) + i)
        return F.transform(F.when(needed, near).otherwise(F.array().cast("array<bigint>")), lambda m: F.struct(F.lit(i).alias("segment"), F.get("own", F.lit(i)).bitwiseXOR(m).alias("value")))

    values = [around(i, n) for i, n in enumerate(sizes) if radius <= n]
    return active.select("query", "own", "bound", F.explode(F.concat(*values)).alias("p")).select("query", "own", "bound", "p.*")


def opened(probed: DataFrame, held: DataFrame, buckets: DataFrame) -> DataFrame:
    """The probes of buckets that hold codes, with the codes of each cut.

    Both joins shuffle: probes are many for each query, which the planner's size of them doesn't show.
    """
    hits = probed.hint("merge").join(held, ["segment", "value"])
    hits = hits.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
    return hits.hint("merge").join(buckets.drop("cuts"), ["segment", "value", "cut"])


def verified(found: DataFrame, radius: int, many: int) -> DataFrame:
    """query, vec_id, distance of the probed pairs that no smaller radius and no earlier segment gives."""
    apart = [F.bit_count(F.get("own", F.lit(i)).bitwiseXOR(F.get("code.parts", F.lit(i)))) for i in range(many)]
    rows = found.select("query", "own", "bound", "segment", F.explode("codes").alias("code"))
    rows = rows.select("query", "bound", "segment", "code.ids", F.array(*apart).alias("apart"))
    first = F.array_position("apart", F.array_min("apart")) - 1
    rows = rows.where((F.array_min("apart") == radius) & (first == F.col("segment")))
    rows = rows.withColumn("distance", F.aggregate("apart", F.lit(0), lambda a, x: a + x.cast("int")))
    return rows.where("bound IS NULL OR distance <= bound").select("query", F.explode("ids").alias("vec_id"), "distance")


def search(distinct: DataFrame, asked: DataFrame, sizes: list[int], wanted: int) -> DataFrame:
    """query, vec_id, distance: of each asked code (query, own) the ``wanted`` nearest ids, ties to smaller ids."""
    buckets = stash(bucket_table(distinct), "code-buckets")
    held = stash(buckets.select("segment", "value", "cuts").distinct(), "code-bucket-sizes")  # probes of empty buckets end here
    active, best, done = asked.withColumn("bound", F.lit(None).cast("int")), None, []
    for radius in range(max(sizes) + 1):
        found = verified(opened(probes(active, sizes, radius), held, buckets), radius, len(sizes))
        both = (found if best is None else best.union(found)).groupBy("query", "vec_id").agg(F.min("distance").alias("distance"))
        place = F.row_number().over(W.partitionBy("query").orderBy("distance", "vec_id"))
        best = stash(both.withColumn("place", place).where(F.col("place") <= wanted).drop("place"), "code-best")
        within = len(sizes) * (radius + 1)  # every code nearer than this is known, where all segments were probed
        near, known = F.count_if(F.col("distance") < within), active.select("query", F.col("bound").alias("earlier"))
        state = best.groupBy("query").agg((near >= wanted).alias("enough"), F.when(F.count("*") >= wanted, F.max("distance")).alias("bound"))
        # Where not all were, the bound of the round before is covered.
        state = stash(state.join(known, "query").select("query", (F.col("enough") | F.coalesce(F.col("earlier") < within, F.lit(False))).alias("settled"), "bound"), "code-state")
        settled = state.where("settled").select("query")
        done.append(best.join(settled, "query", "left_semi"))
        best = best.join(settled, "query", "left_anti")
        # Written out, so that a round's plan doesn't hold the rounds before it.
        active = stash(active.drop("bound").join(state, "query", "left").where("settled IS NULL OR NOT settled").drop("settled"), "code-active")
        if active.isEmpty():
            break
    else:
        done.append(best)  # fewer ids than wanted
    return reduce(DataFrame.union, done)


def top_k(codes: DataFrame, k: int, is_query) -> DataFrame:
    """query_id, rank, vec_id, distance: of each id of ``codes`` (id, code) with ``is_query``, the k nearest other ids."""
    widths = codes.where("id IS NOT NULL AND octet_length(code) > 0").groupBy(F.octet_length("code").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = widths["width"] if widths else 1
    codes = stash(codes.where((F.octet_length("code") == width) & F.col("id").isNotNull()).select("id", "code"), "codes")
    # A query's own id may be among the nearest of its code, at each of its rows.
    wanted = k + 1
    distinct = stash(smallest_ids(codes.distinct(), "code", wanted), "distinct-codes")
    sizes = segment_sizes(8 * width, distinct.count())
    parts = distinct.select("code", "ids", segments(bit_text(F.col("code"), width), sizes).alias("parts"))
    queries = codes.where(is_query).distinct()
    asked = stash(queries.select("code").distinct().join(parts.drop("ids"), "code").select(F.col("code").alias("query"), F.col("parts").alias("own")), "asked-codes")
    found = search(parts.select("parts", "ids"), asked, sizes, wanted)
    pairs = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(found, "query").where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "distance")
