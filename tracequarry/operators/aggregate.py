"""The global aggregations, each one row; errors are raised by the row's own expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.nodes import Aggregate
from ..plans.resolver import NUMBER

#: Message texts that clients may compare. Fixed values.
NO_EVENTS = "no matching events to aggregate"
WRONG_TYPE = "field '{}' has incompatible type for numeric aggregation"
NOT_FOUND = "field '{}' not found in any matching event"


class AggregationError(ValueError):
    """The aggregation has no result for the matching rows."""


def guarded(value: Column, rows: Column, wrong: Column, found: Column, field: str) -> Column:
    """No rows, then any value of another kind, then no value at all: in this order."""
    return (
        F.when(rows == 0, F.raise_error(F.lit(NO_EVENTS)))
        .when(wrong > 0, F.raise_error(F.lit(WRONG_TYPE.format(field))))
        .when(found == 0, F.raise_error(F.lit(NOT_FOUND.format(field))))
        .otherwise(value)
    )


def name_of(stage: Aggregate) -> str:
    return {"percentile": f"p{stage.percent}", "count_by": "count"}.get(stage.kind, stage.kind)


def aggregate(rows: DataFrame, stage: Aggregate, resolver) -> DataFrame:
    """One row with one column, named after the aggregation. Sums run in double precision over 32-bit values."""
    name = name_of(stage)
    if stage.kind == "count":
        return rows.agg(F.count(F.lit(1)).alias(name))
    if stage.kind == "count_by":
        return rows.agg(F.count_if(resolver.present(stage.field)).alias(name))
    x = resolver.value(stage.field, NUMBER)
    wrong = resolver.present(stage.field) & ~F.coalesce(resolver.is_kind(stage.field, NUMBER), F.lit(False))
    values = rows.select(x.alias("x"), wrong.alias("wrong"))
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if("wrong").alias("wrong"), F.count("x").alias("found")]
    if stage.kind == "percentile":
        picked = percentile(values, stage.percent)
        return picked.select(guarded(F.col("value"), F.col("rows"), F.col("wrong"), F.col("found"), stage.field).alias(name))
    found = {"avg": F.avg(F.col("x").cast("double")), "sum": F.sum(F.col("x").cast("double")), "min": F.min("x"), "max": F.max("x")}[stage.kind]
    totals = values.agg(*counts, found.cast("float").alias("value"))
    return totals.select(guarded(F.col("value"), F.col("rows"), F.col("wrong"), F.col("found"), stage.field).alias(name))


def octave_bucket(x: Column) -> Column:
    """A monotone integer of a float: sign, exponent, and the mantissa's first eight bits; under 150,000 values."""
    size = F.abs(x.cast("double"))
    power = F.when(size == float("inf"), F.lit(128.0)).otherwise(F.floor(F.log2(size)))
    part = F.when(size == float("inf"), F.lit(0)).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((size / F.pow(F.lit(2.0), power) - 1) * 256))))
    bucket = ((power + 150) * 256 + part + 1).cast("int")
    return F.when(x == 0, F.lit(0)).when(F.isnan(x), F.lit(1 << 20)).when(x < 0, -bucket).otherwise(bucket)


def percentile(values: DataFrame, percent: int) -> DataFrame:
    """One row with ``value`` (nearest rank, the rank in 32-bit arithmetic), rows, wrong and found, from x and wrong.

    Two scans find it without a sort of the rows: over the buckets of ``octave_bucket``, with the
    counts for the guards beside them, then over the distinct values of the one bucket that holds
    the rank (at most 2**15). So the two ordered windows are of bounded size.
    """
    values = values.withColumn("bucket", octave_bucket(F.col("x")))
    share = (F.lit(percent).cast("float") / F.lit(100).cast("float")).cast("float")
    # Rows without a value are in the null bucket, which comes first and counts nothing.
    buckets = values.groupBy("bucket").agg(F.count("x").alias("n"), F.count(F.lit(1)).alias("rows"), F.count_if("wrong").alias("wrong"))
    before = F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumns({"before": before, "total": F.sum("n").over(W.partitionBy())})
    rank = F.least(F.ceil((share * F.col("total").cast("float")).cast("float")).cast("long"), F.col("total"))
    holds = (F.col("before") < rank) & (rank <= F.col("before") + F.col("n"))
    holder = F.max(F.when(holds, F.struct("bucket", (rank - F.col("before")).alias("rank")))).alias("holder")
    state = buckets.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong"), F.coalesce(F.sum("n"), F.lit(0)).alias("found"), holder)
    one = state.select("holder.*").where("bucket IS NOT NULL")
    inside = values.select("x", "bucket").join(F.broadcast(one), "bucket").groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.first("rank").alias("rank"))
    upto = F.sum("n").over(W.orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    picked = inside.withColumn("upto", upto).where("rank <= upto").agg(F.min("x").alias("value"))
    return state.drop("holder").join(picked, F.lit(True), "left")  # one row each
