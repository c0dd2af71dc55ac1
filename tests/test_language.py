from datetime import UTC, datetime, timedelta

import numpy as np
import pytest

from tracequarry.functions.values import literal, percentile_rank, rounding_interval, shown
from tracequarry.plans.nodes import Aggregate, All, And, Compare, Limit, Not, Or, TimeBound
from tracequarry.plans.parser import IncorrectFormat, ParseError, UnknownOperator, parse, tokenize

NOW = datetime(2026, 1, 15, 12, tzinfo=UTC)


@pytest.mark.parametrize("token, value", [("500", 500.0), ("1e3", 1000.0), ("+5", 5.0), (".5", 0.5), ("5.", 5.0), ("inf", np.inf), ("-Infinity", -np.inf), ("true", True), ("false", False), ("TRUE", "TRUE"), ("1_000", "1_000"), ("0x1", "0x1"), ("ERROR", "ERROR"), ("0.1", float(np.float32(0.1))), ("1e400", np.inf), ("١", "١")])
def test_literals(token, value):
    assert literal(token) == value and type(literal(token)) is type(value)


def test_nan_literal():
    assert np.isnan(literal("NaN"))


def test_shown():
    assert [shown(x) for x in (200, 0.1, 1e20, -2.5, 16777216, float("inf"))] == ["200", "0.1", "100000000000000000000", "-2.5", "16777216", "inf"]


def test_percentile_rank_is_in_32_bits():
    assert percentile_rank(60, 25) == 16 and percentile_rank(7, 100) == 7 and percentile_rank(55, 100) == 55 and percentile_rank(9, 300) == 28 and percentile_rank(100, 5) == 5


def test_rounding_interval_against_casts():
    rng = np.random.default_rng(1)
    for f in [0.0, 1.0, 0.1, -2.5, 16777216.0, 3.4028234663852886e38, 1e-45, *rng.normal(size=200), *rng.lognormal(0, 30, 200)]:
        f = float(np.float32(f))
        if not np.isfinite(f):
            continue
        low, low_in, high, high_in = rounding_interval(f)
        with np.errstate(over="ignore"):
            for x, inside in ((low, low_in), (high, high_in), (np.nextafter(low, -np.inf), False), (np.nextafter(low, np.inf), True), (np.nextafter(high, np.inf), False), (np.nextafter(high, -np.inf), True)):
                assert (float(np.float32(x)) == f) == inside, (f, x)


def test_tokens_and_shape():
    assert tokenize("(a = 1)") == ["(", "a", "=", "1", ")"]
    assert parse("a = 1 AND b = 2 OR NOT c = x").filter == Or((And((Compare("a", "=", 1.0), Compare("b", "=", 2.0))), Not(Compare("c", "=", "x"))))
    assert parse("(a = 1 AND b = 1) AND c = 1").filter == And((And((Compare("a", "=", 1.0), Compare("b", "=", 1.0))), Compare("c", "=", 1.0)))
    assert parse("level = ERROR|count").filter == Compare("level", "=", "ERROR|count")
    assert parse("AND = 1").filter == Compare("AND", "=", 1.0)
    assert parse("a = |").filter == Compare("a", "=", "|")
    assert parse("a ~ 5").filter == Compare("a", "~", "5")
    assert parse("| COUNT").filter == All()


@pytest.mark.parametrize("text, stage", [("| count", Aggregate("count")), ("| count by x extra", Aggregate("count_by", "x")), ("a = 1 | Avg X", Aggregate("avg", "X")), ("| p99 ms", Aggregate("percentile", "ms", 99)), ("| limit +5", Limit("limit", 5)), ("| TAIL 0", Limit("tail", 0))])
def test_stages(text, stage):
    assert parse(text).stage == stage


@pytest.mark.parametrize(
    "text, kind, message",
    [
        ("", IncorrectFormat, "empty query"),
        ("a = 1 |", IncorrectFormat, "no aggregator after '|'"),
        ("a = 1 b", IncorrectFormat, "unexpected token 'b'"),
        ("a", IncorrectFormat, "expected operator"),
        ("a =", IncorrectFormat, "expected value"),
        ("a == 1", UnknownOperator, "unknown operator: =="),
        ("NOT NOT a = 1", UnknownOperator, "unknown operator: a"),
        ("(a = 1", IncorrectFormat, "expected ')'"),
        ("a = 1 AND", IncorrectFormat, "expected field name"),
        ("| limit", IncorrectFormat, "'limit' requires a count, e.g.: limit 10"),
        ("| limit -1", IncorrectFormat, "invalid count '-1'"),
        ("| limit 1 | count", IncorrectFormat, "unexpected token '|'"),
        ("| count by", IncorrectFormat, "no field to count by"),
        ("| avg", IncorrectFormat, "'avg' requires a field name, e.g.: avg latency_ms"),
        ("| avg a b", IncorrectFormat, "unexpected token 'b'"),
        ("| p0 a", IncorrectFormat, "percentile must be 1-100, got 0"),
        ("| p300 a", IncorrectFormat, "invalid percentile 'p300'"),
        ("| pxy a", IncorrectFormat, "invalid percentile 'pxy'"),
        ("| p50", IncorrectFormat, "no field for 'p50' aggregation"),
        ("| median a", IncorrectFormat, "unknown aggregator 'median'; expected: count, avg, sum, min, max, or p<N> (e.g. p99)"),
        ("(" * 100_000, IncorrectFormat, "query nesting too deep"),
        ("t = now", UnknownOperator, "unknown operator: ="),
        ("t > yesterday", IncorrectFormat, "invalid datetime"),
        ("t > 2026", IncorrectFormat, "invalid datetime"),
        ("t > -99999999999999d", IncorrectFormat, "invalid datetime"),
    ],
)
def test_errors(text, kind, message):
    with pytest.raises(kind) as error:
        parse(text, "t", NOW)
    assert message in str(error.value) and isinstance(error.value, ParseError)


def test_depth():
    parse("(" * 128 + "a = 1" + ")" * 128)
    with pytest.raises(IncorrectFormat):
        parse("(" * 129 + "a = 1" + ")" * 129)


def test_times():
    at = {"now": NOW, "-1h": NOW - timedelta(hours=1), "-0s": NOW, "2026-01-15T01:00:00+01:00": datetime(2026, 1, 15, tzinfo=UTC), "2026-01-15T00:00:00.123456789Z": datetime(2026, 1, 15, 0, 0, 0, 123456, tzinfo=UTC)}
    for text, want in at.items():
        assert parse(f"t > {text}", "t", NOW).filter == TimeBound(since=want)
    assert parse("t < now", "t", NOW).filter == TimeBound(until=NOW)
    assert parse("t < now", None, NOW).filter == Compare("t", "<", "now")


def test_tokens_are_parted_by_white_space_alone():
    from tracequarry.plans.parser import tokenize

    assert tokenize("a\x1cb = \u00a0c\u3000(d)") == ["a\x1cb", "=", "c", "(", "d", ")"]
    assert tokenize(" \t\n") == [] and tokenize("((a") == ["(", "(", "a"]
