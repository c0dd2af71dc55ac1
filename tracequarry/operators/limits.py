"""First and last rows in insertion order, and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.nodes import Limit

#: Most rows that one sort with a limit gives; parts that a range of positions is counted in.
MOST, PARTS = (1 << 31) - 1, 1 << 16


def limit(rows: DataFrame, stage: Limit, order_by: tuple[str, ...]) -> DataFrame:
    """``limit``: the first rows; ``tail``: the last ones, in ascending order."""
    up = [F.col(c).asc() for c in order_by]
    if stage.count > MOST:
        return newest(rows, stage.count, order_by, stage.kind == "tail").orderBy(*up)
    if stage.kind == "limit":
        return rows.orderBy(*up).limit(stage.count)
    return rows.orderBy(*(F.col(c).desc() for c in order_by)).limit(stage.count).orderBy(*up)


def retained(rows: DataFrame, most: int, order_by: tuple[str, ...]) -> DataFrame:
    """The newest ``most`` rows."""
    return newest(rows, most, order_by, True)


def newest(rows: DataFrame, most: int, order_by: tuple[str, ...], last: bool) -> DataFrame:
    """The last (or first) ``most`` rows; a null position is before all others.

    With one integer position a bound on it is found by counting, so no task sorts the rows that are
    kept and the bound reaches the scan. Else, and for streams, the rows are sorted and limited.
    """
    at = F.col(order_by[0])
    if len(order_by) == 1 and isinstance(rows.schema[order_by[0]].dataType, T.IntegralType) and not rows.isStreaming:
        low, high, many, nulls = rows.agg(F.min(at.cast("long")), F.max(at.cast("long")), F.count("*"), F.count_if(at.isNull())).first()
        if many <= most:
            return rows
        if most == 0:
            return rows.limit(0)
        if not nulls:
            bound, room = position_bound(rows.select(at.cast("long").alias("at")), low, high, most, last)
            if room is None:
                return rows.where(at >= bound if last else at <= bound)
            # Rows that share the position at the bound: as many as there is room for.
            return rows.where(at > bound if last else at < bound).union(rows.where(at == bound).limit(room))
    elif most > MOST and rows.count() <= most:
        return rows
    if most > MOST:
        raise ValueError(f"more than {MOST} of even more rows need one integer position without nulls")
    return rows.orderBy(*(F.col(c).desc() if last else F.col(c).asc() for c in order_by)).limit(most)


def position_bound(positions: DataFrame, low: int, high: int, most: int, last: bool) -> tuple[int, int | None]:
    """Position from which on (or up to which) ``most`` rows are kept, and how many of the rows at it (None: all).

    Each step counts the rows in at most 2 * PARTS parts of the range that holds the bound.
    """
    left = most
    while True:
        bits = max(0, (high - low).bit_length() - PARTS.bit_length() + 1)
        parts = positions.where(F.col("at").between(low, high)).groupBy(F.shiftright("at", bits).alias("part")).count().collect()
        for part, count in sorted(map(tuple, parts), reverse=last):
            if count >= left:
                break
            left -= count
        low, high = max(low, part << bits), min(high, (part + 1 << bits) - 1)
        if bits == 0:
            return part, None if count == left else left
