"""Filter nodes to Catalyst columns.

A leaf is true, or else false or null; only ``NOT`` tells these apart, so only there null becomes
false, and positive predicates stay bare for the scan. Numbers compare as 32-bit floats: on
double and integer columns that is rewritten to bounds on the column itself, which push down.
"""

from __future__ import annotations

import math
import operator
from datetime import UTC
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import rounding_interval
from .nodes import All, And, Compare, Filter, Not, Or, TimeBound
from .resolver import BOOL, NUMBER, STRING, TypedResolver, VariantResolver, quoted

_APPLY = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
Resolver = TypedResolver | VariantResolver


class Compiler:
    """``time_column``: its name and whether it has no zone. ``native``: numbers compare as they are stored."""

    def __init__(self, resolver: Resolver, time_column: tuple[str, bool] | None = None, native: bool = False):
        self.resolver, self.time_column, self.native = resolver, time_column, native

    def column(self, node: Filter) -> Column:
        if isinstance(node, All):
            return F.lit(True)
        if isinstance(node, And):
            return reduce(operator.and_, map(self.column, node.parts))
        if isinstance(node, Or):
            return reduce(operator.or_, map(self.column, node.parts))
        if isinstance(node, Not):
            return ~F.coalesce(self.column(node.part), F.lit(False))
        if isinstance(node, TimeBound):
            return self.time(node)
        return self.compare(node)

    def time(self, node: TimeBound) -> Column:
        if not self.time_column:
            return F.lit(False)
        name, zoneless = self.time_column
        at = (node.since or node.until).astimezone(UTC)
        text = at.strftime("%Y-%m-%d %H:%M:%S.%f").rjust(26, "0")
        bound = F.lit(text).cast("timestamp_ntz") if zoneless else F.lit(text + "+00:00").cast("timestamp")
        return quoted(name) >= bound if node.since else quoted(name) <= bound

    def compare(self, node: Compare) -> Column:
        field, op, value = node.field, node.op, node.value
        if op == "~":
            return self.resolver.value(field, STRING).contains(F.lit(value))
        if op == "!=":
            return self.resolver.present(field) & ~F.coalesce(self.compare(Compare(field, "=", value)), F.lit(False))
        kind = BOOL if isinstance(value, bool) else NUMBER if isinstance(value, float) else STRING
        if not self.resolver.dynamic and self.resolver.kind(field) != kind or kind == NUMBER and math.isnan(value):
            return F.lit(False)
        if kind == NUMBER:
            return self.number(field, op, value)
        return _APPLY[op](self.resolver.value(field, kind), F.lit(value))

    def number(self, field: str, op: str, value: float) -> Column:
        if not self.resolver.dynamic:
            kind, column = self.resolver.types[field], self.resolver.raw(field)
            if self.native:
                return _APPLY[op](column, F.lit(value))
            if isinstance(kind, T.DoubleType) and math.isfinite(value):
                return self.bounded(column, op, value)
            if isinstance(kind, T.IntegralType) and abs(value) < 2**53:
                return self.whole(column, op, value)
        column = self.resolver.value(field, NUMBER)
        found = _APPLY[op](column, F.lit(value).cast("float"))
        return found & ~F.isnan(column) if op in (">", ">=") else found

    def bounded(self, column: Column, op: str, value: float) -> Column:
        """Rounding to 32 bits is monotone, so each comparison is a bound on the double."""
        low, low_in, high, high_in = rounding_interval(value)
        above = column >= F.lit(low) if low_in else column > F.lit(low)
        below = column <= F.lit(high) if high_in else column < F.lit(high)
        if op == "=":
            return above & below
        if op == "<":
            return column < F.lit(low) if low_in else column <= F.lit(low)
        if op == "<=":
            return below
        found = above if op == ">=" else (column > F.lit(high) if high_in else column >= F.lit(high))
        return found & ~F.isnan(column)  # NaN is above all in Spark, and compares to nothing here

    def whole(self, column: Column, op: str, value: float) -> Column:
        low, low_in, high, high_in = rounding_interval(value)
        first = math.ceil(low) if low_in or low != math.ceil(low) else math.ceil(low) + 1
        last = math.floor(high) if high_in or high != math.floor(high) else math.floor(high) - 1
        if op == "=":
            if first > last:
                return F.lit(False)
            return column == F.lit(first) if first == last else (column >= F.lit(first)) & (column <= F.lit(last))
        return {"<": column < F.lit(first), "<=": column <= F.lit(last), ">": column > F.lit(last), ">=": column >= F.lit(first)}[op]
