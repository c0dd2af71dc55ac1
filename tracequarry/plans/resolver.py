"""How a field's presence, kind and value are read from a row, for typed and for dynamic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, STRING, BOOL = "number", "string", "bool"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class TypedResolver:
    """Ordinary columns: a field's kind is known from the schema, null means absent."""

    dynamic = False

    def __init__(self, df: DataFrame, hidden: tuple[str | None, ...] = ()):
        self.types = {f.name: f.dataType for f in df.schema.fields if f.name not in hidden}

    def kind(self, field: str) -> str | None:
        kind = self.types.get(field)
        if isinstance(kind, T.NumericType):
            return NUMBER
        if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
            return STRING
        return BOOL if isinstance(kind, T.BooleanType) else None

    def raw(self, field: str) -> Column:
        return quoted(field)

    def present(self, field: str) -> Column:
        return quoted(field).isNotNull() if self.kind(field) else F.lit(False)

    def is_kind(self, field: str, kind: str) -> Column:
        return self.present(field) if self.kind(field) == kind else F.lit(False)

    def value(self, field: str, kind: str) -> Column:
        """The value if it is of that kind, else null; numbers as float."""
        if self.kind(field) != kind:
            return F.lit(None).cast({NUMBER: "float", STRING: "string", BOOL: "boolean"}[kind])
        if kind != NUMBER:
            return quoted(field)
        return (quoted(field).cast("double") if isinstance(self.types[field], T.DecimalType) else quoted(field)).cast("float")


class VariantResolver:
    """A VARIANT column of a JSON object: each row's field has its own kind.

    ``ready``: fields that ``prepared`` has put into columns of their own, which are read instead.
    """

    dynamic = True
    _TYPES = {NUMBER: "double", STRING: "string", BOOL: "boolean"}

    def __init__(self, column: str = "v", hidden: tuple[str | None, ...] = (), ready: dict[str, str] | None = None):
        self.column, self.hidden, self.ready = column, hidden, ready or {}

    def entry(self, field: str) -> Column:
        """The field as VARIANT, null if the row hasn't got it."""
        if "'" not in field:
            return F.try_variant_get(F.col(self.column), f"$['{field}']", "variant")
        if '"' not in field:
            return F.try_variant_get(F.col(self.column), f'$["{field}"]', "variant")
        # A path can't hold both kinds of quotes, a map's key can.
        return F.try_element_at(F.try_variant_get(F.col(self.column), "$", "map<string,variant>"), F.lit(field))

    def prepared(self, df: DataFrame, fields: set[str]) -> tuple[DataFrame, VariantResolver, list[str]]:
        """``df`` with each field taken out of the row once, a resolver of these columns, and their names."""
        from ..sources.jsonl import once

        names = {f: f"_field{i}" for i, f in enumerate(sorted(fields - set(self.hidden)))}
        taken = df.withColumns({n: once(self.entry(f)) for f, n in names.items()}) if names else df
        kinds = {n + "_kind": once(F.schema_of_variant(n)) for n in names.values()}
        return (taken.withColumns(kinds) if kinds else taken), VariantResolver(self.column, self.hidden, names), [*names.values(), *kinds]

    @staticmethod
    def _kind(name: Column) -> Column:
        number = name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")
        return F.when(number, NUMBER).when(name == "STRING", STRING).when(name == "BOOLEAN", BOOL)

    def found_kind(self, field: str) -> Column:
        if field in self.hidden:
            return F.lit(None).cast("string")
        return self._kind(F.col(self.ready[field] + "_kind") if field in self.ready else F.schema_of_variant(self.entry(field)))

    def present(self, field: str) -> Column:
        return self.found_kind(field).isNotNull()

    def is_kind(self, field: str, kind: str) -> Column:
        return self.found_kind(field) == kind

    def value(self, field: str, kind: str) -> Column:
        if field in self.hidden:
            return F.lit(None).cast({NUMBER: "float", STRING: "string", BOOL: "boolean"}[kind])
        entry = F.col(self.ready[field]) if field in self.ready else self.entry(field)
        found = F.when(self.is_kind(field, kind), F.try_variant_get(entry, "$", self._TYPES[kind]))
        return found.cast("float") if kind == NUMBER else found
