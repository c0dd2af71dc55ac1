"""Query a log table by text."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .functions.values import shown
from .operators.aggregate import NO_EVENTS, AggregationError, aggregate
from .operators.limits import limit, retained
from .plans.compiler import Compiler
from .plans.nodes import Aggregate, Limit, Plan, fields_of
from .plans.parser import ParseError, parse
from .plans.resolver import TypedResolver, VariantResolver
from .sources.jsonl import read_jsonl, timestamp_of

__all__ = ["AggregationError", "LogTable", "ParseError", "from_jsonl", "render"]


class LogTable:
    """Rows, typed or dynamic (with the columns raw and v), an order of insertion and maybe a time field.

    The time field holds a timestamp, or RFC 3339 text; it is no ordinary field. ``numbers``: ``f32``
    (numbers compare as 32-bit floats) or ``native`` (typed columns compare as stored).
    """

    def __init__(self, df: DataFrame, time_field: str | None = None, order_by: str | tuple[str, ...] = "_pos", numbers: str = "f32"):
        self.order_by = (order_by,) if isinstance(order_by, str) else tuple(order_by)
        self.time_field = time_field
        kinds = {f.name: f.dataType for f in df.schema.fields}
        time_column = None
        if isinstance(kinds.get("v"), T.VariantType):
            self.resolver = VariantResolver("v", (time_field,))
            time_column = ("_ts", False)
        else:
            self.resolver = TypedResolver(df, (time_field, "_pos", "_ts", "raw"))
            if isinstance(kinds.get(time_field), T.StringType):
                df = df.withColumn("_ts", timestamp_of(df[time_field]))
                time_column = ("_ts", False)
            elif isinstance(kinds.get(time_field), (T.TimestampType, T.TimestampNTZType)):
                time_column = (time_field, isinstance(kinds[time_field], T.TimestampNTZType))
        self.df, self.compiler = df, Compiler(self.resolver, time_column, numbers == "native")

    def query(self, text: str, now: datetime | None = None) -> DataFrame:
        """The matching rows, or one row of an aggregation. An aggregation's errors show when it runs."""
        plan = parse(text, self.time_field, now)
        rows, resolver, extra = self.matching(plan)
        if isinstance(plan.stage, Aggregate):
            return aggregate(rows, plan.stage, resolver)
        rows = rows.drop(*extra)
        return limit(rows, plan.stage, self.order_by) if isinstance(plan.stage, Limit) else rows

    def matching(self, plan: Plan) -> tuple[DataFrame, TypedResolver | VariantResolver, list[str]]:
        """The rows that the plan's filter keeps, how their fields are read, and the columns added for that."""
        if not self.resolver.dynamic:
            return self.df.where(self.compiler.column(plan.filter)), self.resolver, []
        rows, resolver, extra = self.resolver.prepared(self.df, fields_of(plan))
        compiler = Compiler(resolver, self.compiler.time_column, self.compiler.native)
        return rows.where(compiler.column(plan.filter)), resolver, extra

    def follow(self, text: str, now: datetime | None = None) -> DataFrame:
        """The same filter for a streaming table; stages don't apply to a stream."""
        if "|" in text:
            raise ParseError("follow supports filters only, not '|' stages")
        rows, _, extra = self.matching(parse(text, self.time_field, now))
        return rows.drop(*extra)

    def retained(self, most: int = 2_000_000) -> LogTable:
        """The newest ``most`` rows."""
        kept = LogTable.__new__(LogTable)
        kept.__dict__ = self.__dict__ | {"df": retained(self.df, most, self.order_by)}
        return kept

    def answer(self, text: str, now: datetime | None = None) -> str:
        """The result as text: lines of ``raw`` in order, or a number."""
        plan = parse(text, self.time_field, now)
        found = self.query(text, now)
        try:
            if isinstance(plan.stage, Aggregate):
                return render(found)
            return render(found.orderBy(*self.order_by))
        except PySparkException as error:
            raise aggregation_error(error) from error


def aggregation_error(error: PySparkException) -> Exception:
    """The engine's error behind one that Spark raised, or that one itself."""
    text = str(error)
    for start in (NO_EVENTS, "field '"):
        at = text.find(start)
        if at >= 0 and "USER_RAISED_EXCEPTION" in text:
            return AggregationError(text[at:].split("\n")[0].split(" SQLSTATE")[0].strip())
    return error


def render(found: DataFrame) -> str:
    if "raw" in found.columns:
        return "\n".join(r.raw for r in found.select("raw").collect())
    rows = found.collect()
    if len(found.columns) == 1 and len(rows) == 1 and not isinstance(rows[0][0], str):
        return shown(rows[0][0]) if isinstance(rows[0][0], float) else str(rows[0][0])
    return "\n".join("\t".join(map(str, r)) for r in rows)


def from_jsonl(spark: SparkSession, path: str, time_field: str | None = None, strict: bool = False) -> LogTable:
    return LogTable(read_jsonl(spark, path, time_field, strict), time_field)


