"""The query plan: filter nodes, and at most one stage."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from ..functions.values import Literal


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: Literal


@dataclass(frozen=True)
class TimeBound:
    """Inclusive on both sides; one of the two is set."""

    since: datetime | None = None
    until: datetime | None = None


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


Filter = All | Compare | TimeBound | And | Or | Not


@dataclass(frozen=True)
class Aggregate:
    """kind: count, count_by, avg, sum, min, max or percentile."""

    kind: str
    field: str | None = None
    percent: int | None = None


@dataclass(frozen=True)
class Limit:
    kind: str  # limit or tail
    count: int


@dataclass(frozen=True)
class Plan:
    filter: Filter
    stage: Aggregate | Limit | None = None


def fields_of(plan: Plan) -> set[str]:
    """The fields that the plan reads."""

    def inside(node: Filter) -> set[str]:
        if isinstance(node, Compare):
            return {node.field}
        if isinstance(node, Not):
            return inside(node.part)
        return set().union(*map(inside, node.parts)) if isinstance(node, (And, Or)) else set()

    field = plan.stage.field if isinstance(plan.stage, Aggregate) else None
    return inside(plan.filter) | ({field} if field else set())
