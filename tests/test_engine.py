"""Both table layouts against a plain evaluator, fixed inputs, and the errors of aggregations."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracequarry.plans.nodes import All, And, Compare, Not, Or
from tracequarry.plans.parser import parse
from tracequarry.session import AggregationError, LogTable, ParseError, from_jsonl
from tracequarry.sources.jsonl import MalformedLine, decoded, timestamp_of


def matches(row: dict, node) -> bool:
    """One row against a filter, by the language's own rules."""
    if isinstance(node, All):
        return True
    if isinstance(node, And):
        return all(matches(row, p) for p in node.parts)
    if isinstance(node, Or):
        return any(matches(row, p) for p in node.parts)
    if isinstance(node, Not):
        return not matches(row, node.part)
    found = row.get(node.field)
    if found is None or isinstance(found, (list, dict)):
        return False
    if isinstance(found, (int, float)) and not isinstance(found, bool):
        found = float(np.float32(found))
    value = node.value
    if node.op == "~":
        return isinstance(found, str) and value in found
    same = type(found) is type(value)
    if node.op == "!=":
        return not (same and found == value)
    return same and {"=": found == value, "<": found < value, "<=": found <= value, ">": found > value, ">=": found >= value}[node.op]


def rows_of(seed: int, many: int = 60) -> list[dict]:
    r = random.Random(seed)
    return [
        {"_pos": i, "a": r.choice([None, 0.1, 1.5, 16777217.0, -3.0, 7.0]), "b": r.choice([None, 1, 5, 16777217, 2**40]), "c": r.choice([None, "x", "xyz", "5", "true", ""]), "d": r.choice([None, True, False])}
        for i in range(many)
    ]


def filter_text(r: random.Random, depth: int = 0) -> str:
    if depth < 3 and r.random() < 0.5:
        kind = r.choice(["AND", "OR", "NOT"])
        if kind == "NOT":
            return f"NOT ( {filter_text(r, depth + 1)} )"
        return f"( {filter_text(r, depth + 1)} ) {kind} ( {filter_text(r, depth + 1)} )"
    return f"{r.choice('abcde')} {r.choice(['=', '!=', '<', '<=', '>', '>=', '~'])} {r.choice(['1', '5', '0.1', '1.5', '16777216', '7', 'x', 'true', 'false', 'yz', 'nan', 'inf', '1e12', '-3'])}"


def test_random_filters_on_both_layouts(spark):
    rows = rows_of(3)
    schema = "_pos long, a double, b long, c string, d boolean"
    typed = LogTable(spark.createDataFrame([tuple(r.values()) for r in rows], schema))
    lines = spark.createDataFrame([(r["_pos"], json.dumps({k: v for k, v in r.items() if k != "_pos"})) for r in rows], "_pos long, value string")
    dynamic = LogTable(decoded(lines))
    r = random.Random(5)
    texts = [filter_text(r) for _ in range(40)]
    for table in (typed, dynamic):
        marks = [table.compiler.column(parse(t).filter) for t in texts]
        found = table.df.select("_pos", *(m.alias(f"m{i}") for i, m in enumerate(marks))).collect()
        for row in found:
            for i, t in enumerate(texts):
                assert bool(row[f"m{i}"]) == matches(rows[row["_pos"]], parse(t).filter), (t, rows[row["_pos"]])


def numbers(spark, values):
    return LogTable(spark.createDataFrame([(i, v, "s") for i, v in enumerate(values)], "_pos long, x double, level string"))


def test_percentiles_by_rank(spark):
    r = random.Random(2)
    for many in (1, 25, 100, 300):
        values = [r.choice([r.gauss(0, 1e3), r.gauss(0, 1e-3), float(r.randint(-5, 5)), 1e30 * r.random()]) for _ in range(many)]
        ordered = sorted(float(np.float32(v)) for v in values)
        table = numbers(spark, values)
        for p in (1, 7, 9, 60, 100):
            rank = int(np.ceil(np.float32(np.float32(p) / np.float32(100)) * np.float32(many)))
            assert table.query(f"| p{p} x").first()[0] == ordered[rank - 1]


def test_aggregates_and_errors(spark):
    table = numbers(spark, [100.0, 200.0, 300.0, None])
    assert [table.answer(f"| {a} x") for a in ("avg", "sum", "min", "max", "p50")] == ["200", "600", "100", "300", "200"]
    assert table.answer("| count") == "4" and table.answer("| count by x") == "3" and table.answer("x > 999 | count") == "0"
    for stage in ("avg", "sum", "min", "max", "p50"):
        for text, message in ((f"level = t | {stage} x", "no matching events to aggregate"), (f"| {stage} level", "field 'level' has incompatible type for numeric aggregation"), (f"| {stage} nosuch", "field 'nosuch' not found in any matching event"), (f"x > 999 | {stage} level", "no matching events to aggregate")):
            with pytest.raises(AggregationError, match=message):
                table.answer(text)


LOG = [
    '{"time":"2026-01-01T00:00:00Z","level":"INFO","ms":4,"path":"/a"}',
    '{"time":"2026-01-01T08:00:00+08:00","level":"ERROR","ms":890.5,"user":1,"tags":["x"],"ok":true}',
    '{"time":"2026-01-02T00:00:00.5Z","level":"ERROR","ms":5000,"user":2,"meta":{"a":1},"ok":false,"user":3}',
    '{"time":"2026-04-","level":"WARN","ms":null,"a.b":"dot","it\'s":7}',
    "42",
]


@pytest.fixture
def log(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(("\r\n".join(LOG) + "\r\nnot json\n" + '{"a":1} x\n' + '{"torn":').encode())
    return str(path)


def test_jsonl(spark, log):
    table = from_jsonl(spark, log, "time")
    counts = {
        "| count": 5, "level = ERROR | count": 2, "tags = x | count": 0, "ok = true | count": 1, "ok = TRUE | count": 0, "user = 3 | count": 1, "user = 2 | count": 0,
        "a.b = dot | count": 1, "it's = 7 | count": 1, "| count by ms": 3, "| count by time": 0, "NOT user = 1 | count": 4, "user != 1 | count": 1, "level ~ RRO | count": 2,
        "time > 2026-01-01T00:00:00Z | count": 3, "time > 2026-01-01T00:00:00Z AND time < 2026-01-01T00:00:00Z | count": 2, "NOT time > 2026-01-01T00:00:00Z | count": 2,
    }
    for text, want in counts.items():
        assert table.answer(text) == str(want), text
    assert table.answer("level = ERROR | tail 1") == LOG[2] and table.answer("| limit 2") == "\n".join(LOG[:2]) and table.answer("level = x") == ""
    assert table.answer("| limit 0") == ""
    assert table.retained(2).answer("| count") == "2" and table.retained(2).answer("| limit 1") == LOG[3]
    with pytest.raises(MalformedLine, match="line 6 is not valid JSON"):
        from_jsonl(spark, log, "time", strict=True)
    with pytest.raises(ParseError):
        table.follow("level = ERROR | count")
    with pytest.raises(ParseError):
        table.follow("level = a|b")


def test_jsonl_order_over_many_partitions(spark, tmp_path):
    path = tmp_path / "many.log"
    path.write_text("".join(f'{{"n":{i}}}\n' for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        table = from_jsonl(spark, str(path))
        assert table.df.rdd.getNumPartitions() > 5
        assert table.answer("n >= 10000 | limit 2") == '{"n":10000}\n{"n":10001}' and table.answer("| tail 1") == '{"n":19999}'
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_timestamps_follow_rfc_3339(spark):
    texts = ["2026-01-15T00:00:00Z", "2026-01-15t01:00:00.1234567+01:00", "2026", "2026-01-15 00:00:00", "2026-01-15T00:00:00", "2026-13-15T00:00:00Z"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(timestamp_of(F.col("t")).cast("string")).collect()]
    assert found == ["2026-01-15 00:00:00", "2026-01-15 00:00:00.123456", None, None, None, None]


def test_predicates_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(100).selectExpr("id AS _pos", "CAST(id AS DOUBLE) AS x", "CAST(id AS STRING) AS s", "id AS n", "timestamp_ntz'2024-01-01' AS ts").write.parquet(path)
    table = LogTable(spark.read.parquet(path), "ts")
    plan = table.query("x = 0.1 AND n > 5 AND s ~ 1 AND ts > 2024-01-01T00:00:00Z | count")._jdf.queryExecution().executedPlan().toString()
    for part in ("GreaterThan(x,", "LessThan(x,", "GreaterThan(n,5)", "StringContains(s,1)", "GreaterThanOrEqual(ts,"):
        assert part in plan, plan
    limited = table.query("n > 5 | tail 3")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in limited


def test_retention_finds_its_bound(spark):
    r = random.Random(4)
    for values in ([r.randint(-(1 << 62), 1 << 62) for _ in range(500)], [r.randint(0, 40) for _ in range(300)], [7] * 50, list(range(200))):
        table = LogTable(spark.createDataFrame([(v, 1.0) for v in values], "_pos long, x double"))
        for most in (0, 1, 17, 199, 1000):
            assert sorted(row._pos for row in table.retained(most).df.collect()) == sorted(values)[max(0, len(values) - most) :], most
    plan = LogTable(spark.range(1000).selectExpr("id AS _pos")).retained(10).df._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "TakeOrdered" not in plan
    nulls = LogTable(spark.createDataFrame([(1,), (None,), (2,)], "_pos long"))
    assert sorted(row._pos for row in nulls.retained(2).df.collect()) == [1, 2]


def test_limits_beyond_one_sort(spark):
    table = LogTable(spark.range(5).selectExpr("id AS _pos", "CAST(id AS STRING) AS raw"))
    assert table.answer(f"| tail {1 << 40}") == "0\n1\n2\n3\n4" and table.answer(f"| limit {1 << 40}") == "0\n1\n2\n3\n4"


def test_lines_that_only_look_whole(spark):
    lines = ['{"a":1}', '{"a":1} x', '1],[2', '1},{"v":2', "1,2", "", " 3 ", '{"a":1}]', "[1", "null", '"s"', '{"k\'\\"":5}', '{"a":1,"a":2}', "nul"]
    found = decoded(spark.createDataFrame(list(enumerate(lines)), "_pos long, value string"))
    assert [row._pos for row in found.where("v IS NOT NULL").orderBy("_pos").collect()] == [0, 6, 9, 10, 11, 12]
    table = LogTable(found.where("v IS NOT NULL"))
    assert table.answer("a = 2 | count") == "1" and table.answer("k'\" = 5 | count") == "1" and table.answer("k'\" != 5 | count") == "0"
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_a_line_is_parsed_once(spark):
    lines = spark.range(10).selectExpr("id AS _pos", "to_json(struct(id AS a, id AS b, id AS c)) AS value")
    table = LogTable(decoded(lines).where("v IS NOT NULL"))
    plan = table.query("a > 3 AND b > 3 OR NOT c = 7 AND a < 9")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") <= 1 and plan.lower().count("parse_json") + plan.count("parseJson") <= 2, plan
