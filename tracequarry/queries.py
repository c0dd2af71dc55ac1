"""The engine's registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.limits import position_bound
from .session import LogTable, from_jsonl
from .sources.jsonl import decoded
from .streaming.watch import Watch

TABLES = {
    "events": ("ts", ("event_id",), "event_id, ts, user_id, event_type, value, props"),
    "lineitem": ("l_shipdate", ("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey, l_linenumber, l_quantity, l_returnflag"),
    "orders": ("o_orderdate", ("o_orderkey",), "o_orderkey, o_orderstatus, o_totalprice"),
    "customer": (None, ("c_custkey",), "c_custkey, c_acctbal, c_mktsegment"),
    "part": (None, ("p_partkey",), "p_partkey, p_name, p_size"),
    "supplier": (None, ("s_suppkey",), "s_suppkey, s_acctbal"),
    "documents": (None, ("doc_id",), "doc_id, lang, n_chars"),
    "labels": (None, ("doc_id",), "doc_id, quality, toxic"),
    "conversations": (None, ("conv_id", "turn"), "conv_id, turn, role"),
    "pages": (None, ("page_id",), "page_id, url"),
    "embeddings": (None, ("vec_id",), "vec_id, label"),
}

_F = "CAST({} AS FLOAT)".format
_RANK = "CAST(ceil(CAST({} AS FLOAT) / CAST(100 AS FLOAT) * CAST(n AS FLOAT)) AS BIGINT)"


def _percentile(table: str, percent: int, field: str, where: str = "true") -> str:
    ranked = f"SELECT {_F(field)} AS x, row_number() OVER (ORDER BY {_F(field)}) AS r, count(*) OVER () AS n FROM {table} WHERE {where} AND {field} IS NOT NULL"
    return f"SELECT x AS p{percent} FROM ({ranked}) WHERE r = least({_RANK.format(percent)}, n)"


def _error(expression: str) -> str:
    return f"SELECT CAST({expression} AS FLOAT) AS {expression.split('(')[0]} FROM events WHERE event_type = 'error'"


#: name: (table, query text, WHERE of the rows' SQL or the whole SQL)
TYPED: dict[str, tuple[str, str, str]] = {
    "eq_string": ("events", "event_type = error", "event_type = 'error'"),
    "eq_number": ("events", "user_id = 42", f"{_F('user_id')} = {_F(42)}"),
    "eq_float": ("events", "value = 16.5", f"{_F('value')} = {_F(16.5)}"),
    "ne_string": ("events", "event_type != click", "event_type IS NOT NULL AND event_type <> 'click'"),
    "ne_number": ("events", "user_id != 42", f"{_F('user_id')} <> {_F(42)}"),
    "ne_mixed_kind": ("events", "event_type != 5 | count", "SELECT count(event_type) AS count FROM events"),
    "lt": ("events", "value < 10", f"{_F('value')} < {_F(10)}"),
    "le": ("events", "value <= 10", f"{_F('value')} <= {_F(10)}"),
    "gt": ("events", "value > 100", f"{_F('value')} > {_F(100)}"),
    "ge": ("events", "value >= 100", f"{_F('value')} >= {_F(100)}"),
    "gt_string": ("events", "event_type > error", "event_type > 'error'"),
    "gt_mixed_kind": ("events", "event_type > 5 | count", "SELECT 0 AS count"),
    "nan_literal": ("events", "value != nan | count", "SELECT count(value) AS count FROM events"),
    "contains": ("events", "event_type ~ ur", "contains(event_type, 'ur')"),
    "contains_on_number": ("events", "user_id ~ 4 | count", "SELECT 0 AS count"),
    "time_gt": ("events", "ts > 2024-01-10T00:00:00Z", "ts >= TIMESTAMP '2024-01-10 00:00:00'"),
    "time_lt": ("events", "ts < 2024-01-10T01:00:00+01:00", "ts <= TIMESTAMP '2024-01-10 00:00:00'"),
    "time_range": ("events", "ts > 2024-01-10T00:00:00Z AND ts < 2024-01-12T12:30:00.5Z", "ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 12:30:00.5'"),
    "not_time": ("events", "NOT ts > 2024-01-10T00:00:00Z | count", "SELECT count(*) AS count FROM events WHERE NOT coalesce(ts >= TIMESTAMP '2024-01-10 00:00:00', false)"),
    "time_now": ("events", "ts < now AND ts > 2024-01-10T00:00:00Z | count", "SELECT count(*) AS count FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= now()"),
    "time_relative": ("events", "ts > -100000d | count", "SELECT count(*) AS count FROM events"),
    "and": ("events", "event_type = error AND value > 50", f"event_type = 'error' AND {_F('value')} > {_F(50)}"),
    "or": ("events", "event_type = error OR user_id = 7", f"event_type = 'error' OR {_F('user_id')} = {_F(7)}"),
    "not": ("events", "NOT event_type = error", "NOT coalesce(event_type = 'error', false)"),
    "nested": ("events", "(event_type = error OR event_type = view) AND NOT value > 50", f"(event_type = 'error' OR event_type = 'view') AND NOT coalesce({_F('value')} > {_F(50)}, false)"),
    "not_missing": ("events", "NOT nosuch = 1 | count", "SELECT count(*) AS count FROM events"),
    "match_all_count": ("events", "| count", "SELECT count(*) AS count FROM events"),
    "count": ("events", "event_type = error AND value > 100 | count", f"SELECT count(*) AS count FROM events WHERE event_type = 'error' AND {_F('value')} > {_F(100)}"),
    "count_by": ("events", "value > 100 | count by user_id", f"SELECT count(user_id) AS count FROM events WHERE {_F('value')} > {_F(100)}"),
    "count_by_time": ("events", "| count by ts", "SELECT 0 AS count"),
    "avg": ("events", "event_type = error | avg value", _error("avg(CAST(CAST(value AS FLOAT) AS DOUBLE))")),
    "sum": ("events", "event_type = error | sum value", _error("sum(CAST(CAST(value AS FLOAT) AS DOUBLE))")),
    "min": ("events", "event_type = error | min value", _error("min(CAST(value AS FLOAT))")),
    "max": ("events", "event_type = error | max value", _error("max(CAST(value AS FLOAT))")),
    **{f"p{n}": ("events", f"| p{n} value", _percentile("events", n, "value")) for n in (1, 50, 60, 99, 100)},
    "p90_filtered": ("events", "event_type = error | p90 value", _percentile("events", 90, "value", "event_type = 'error'")),
    "limit": ("events", "event_type = error | limit 5", "SELECT {columns} FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 5"),
    "tail": ("events", "event_type = error | tail 5", "SELECT {columns} FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 5"),
    "limit_zero": ("events", "| limit 0", "SELECT {columns} FROM events LIMIT 0"),
    "lineitem_sum": ("lineitem", "l_returnflag = R | sum l_quantity", f"SELECT CAST(sum(CAST({_F('l_quantity')} AS DOUBLE)) AS FLOAT) AS sum FROM lineitem WHERE l_returnflag = 'R'"),
    "lineitem_p99": ("lineitem", "l_discount > 0.05 | p99 l_extendedprice", _percentile("lineitem", 99, "l_extendedprice", f"{_F('l_discount')} > {_F(0.05)}")),
    "lineitem_discount": ("lineitem", "l_discount = 0.05 AND l_linestatus != F | count", f"SELECT count(*) AS count FROM lineitem WHERE {_F('l_discount')} = {_F(0.05)} AND l_linestatus <> 'F'"),
    "orders_time": ("orders", "o_orderdate > 1996-01-01T00:00:00Z AND o_orderstatus = O", "o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderstatus = 'O'"),
    "orders_median": ("orders", "| p50 o_totalprice", _percentile("orders", 50, "o_totalprice")),
    "customer_negative": ("customer", "c_acctbal < 0 AND NOT c_mktsegment = BUILDING", f"{_F('c_acctbal')} < 0 AND NOT c_mktsegment = 'BUILDING'"),
    "part_contains": ("part", "p_name ~ 1 AND p_size >= 10", f"contains(p_name, '1') AND {_F('p_size')} >= {_F(10)}"),
    "supplier_max": ("supplier", "| max s_acctbal", f"SELECT max({_F('s_acctbal')}) AS max FROM supplier"),
    "documents_contains": ("documents", "text ~ the | count", "SELECT count(*) AS count FROM documents WHERE contains(text, 'the')"),
    "documents_long": ("documents", "lang = en AND n_chars > 5000", f"lang = 'en' AND {_F('n_chars')} > {_F(5000)}"),
    "labels_toxic": ("labels", "toxic = 1 AND NOT quality = 0", f"{_F('toxic')} = {_F(1)} AND NOT coalesce({_F('quality')} = {_F(0)}, false)"),
    "conversations_role": ("conversations", "role = user AND turn > 1", f"role = 'user' AND {_F('turn')} > {_F(1)}"),
    "pages_contains": ("pages", "html ~ <table", "contains(html, '<table')"),
    "array_is_absent": ("embeddings", "NOT embedding = 1 | count by embedding", "SELECT 0 AS count"),
}

#: Over the JSON text of events: (query text, whole SQL). props has a number k on every row.
DYNAMIC: dict[str, tuple[str, str]] = {
    "json_props": ("k > 50 | count", f"SELECT count(*) AS count FROM events WHERE {_F("CAST(props->>'k' AS DOUBLE)")} > {_F(50)}"),
    "json_props_avg": ("k >= 10 | avg k", f"SELECT CAST(avg(CAST({_F("props->>'k'")} AS DOUBLE)) AS FLOAT) AS avg FROM events WHERE {_F("CAST(props->>'k' AS DOUBLE)")} >= {_F(10)}"),
    "json_props_p60": ("| p60 k", _percentile("events", 60, "CAST(props->>'k' AS DOUBLE)")),
}
LINES: dict[str, tuple[str, str]] = {
    "json_filter": ("event_type = error AND value > 100", "SELECT event_id AS _pos FROM events WHERE event_type = 'error' AND CAST(value AS FLOAT) > CAST(100 AS FLOAT)"),
    "json_bool": ("NOT large = true", "SELECT event_id AS _pos FROM events WHERE NOT value > 100"),
    "json_missing": ("few != 1", "SELECT event_id AS _pos FROM events WHERE event_id % 3 = 0 AND user_id <> 1"),
    "json_not_missing": ("NOT few = 1", "SELECT event_id AS _pos FROM events WHERE NOT coalesce(CASE WHEN event_id % 3 = 0 THEN user_id END = 1, false)"),
    "json_mixed_kind": ("mixed = 7 OR mixed = error", "SELECT event_id AS _pos FROM events WHERE CASE WHEN event_id % 2 = 0 THEN user_id = 7 ELSE event_type = 'error' END"),
    "json_time": ("at > 2024-01-10T00:00:00Z AND event_type ~ ew", "SELECT event_id AS _pos FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND contains(event_type, 'ew')"),
    "json_tail": ("event_type = click | tail 7", "SELECT event_id AS _pos FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 7"),
    "json_count_by": ("| count by few", "SELECT count(*) AS count FROM events WHERE event_id % 3 = 0"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> LogTable:
    time_field, order, _ = TABLES[name]
    return LogTable(spark.read.parquet(f"{sf_dir}/{name}.parquet"), time_field, order)


def typed(name: str) -> Callable[[SparkSession, str], DataFrame]:
    source, text, _ = TYPED[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = table(spark, sf_dir, source).query(text)
        return found if len(found.columns) == 1 else found.selectExpr(*TABLES[source][2].split(", "))

    return run


def dynamic(text: str, lines: Callable[[DataFrame], DataFrame], time_field: str | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = decoded(lines(spark.read.parquet(f"{sf_dir}/events.parquet")), time_field).where("v IS NOT NULL")
        found = LogTable(rows, time_field).query(text)
        return found.select("_pos") if "_pos" in found.columns else found

    return run


def props_lines(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("_pos"), F.col("props").alias("value"))


def event_lines(events: DataFrame) -> DataFrame:
    """A JSON line for each event, with a boolean, a field that most rows lack, and one of two kinds."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    numbers = F.struct("event_type", "value", (F.col("value") > 100).alias("large"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("few"), F.col("user_id").alias("mixed"), at.alias("at"))
    texts = F.struct("event_type", "value", (F.col("value") > 100).alias("large"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("few"), F.col("event_type").alias("mixed"), at.alias("at"))
    return events.select(F.col("event_id").alias("_pos"), F.when(F.col("event_id") % 2 == 0, F.to_json(numbers)).otherwise(F.to_json(texts)).alias("value"))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").retained(1000).query("event_type = error").select("event_id", "event_type")


def follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter on a stream of the table's files, run to their end into a Parquet table of the shared folder."""
    path = fresh_folder(spark, "follow")
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    # A folder is streamed as it is; a single file by a pattern that only it matches.
    stream = spark.readStream.schema(schema).parquet(f"{source[:-1]}[{source[-1]}]")
    rows = LogTable(stream, "ts", "event_id").follow("event_type = error AND value > 50").select("event_id", "value")
    rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one; in a temporary folder of this machine only under a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        shared = f"file://{tempfile.gettempdir()}/tracequarry-shared"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def log_folder(spark: SparkSession, sf_dir: str) -> str:
    """Files of JSON lines in the shared folder: with carriage returns, a malformed line for each seventh event, and a torn last line."""
    path = fresh_folder(spark, "lines")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.to_json(F.struct("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at")))
    value = "CASE WHEN event_id % 14 = 0 THEN concat(line, ' x') WHEN event_id % 7 = 0 THEN substring(line, 1, 20) ELSE line END AS value"
    lines = events.select("event_id", line.alias("line")).selectExpr(value)
    lines.select("value").write.option("lineSep", "\r\n").text(path)
    spark.range(1).select(F.lit('{"event_id":-1,"event_type":"error"').alias("value")).write.mode("append").option("lineSep", " ").text(path)
    return path


def json_lines(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = from_jsonl(spark, log_folder(spark, sf_dir), "at").query(text)
        return found if "raw" not in found.columns else found.select(F.try_variant_get("v", "$.event_id", "bigint").alias("event_id"))

    return run


#: Over files of JSON lines with malformed and torn lines: (query text, whole SQL).
FILES: dict[str, tuple[str, str]] = {
    "json_lines_count": ("| count", "SELECT count(*) AS count FROM events WHERE event_id % 7 <> 0"),
    "json_lines_filter": ("event_type = error AND value > 100", f"SELECT event_id FROM events WHERE event_id % 7 <> 0 AND event_type = 'error' AND {_F('value')} > {_F(100)}"),
    "json_lines_time": ("at > 2024-01-10T00:00:00Z AND at < now | count", "SELECT count(*) AS count FROM events WHERE event_id % 7 <> 0 AND ts >= TIMESTAMP '2024-01-10 00:00:00'"),
    "json_lines_max": ("event_type = click | max value", f"SELECT max({_F('value')}) AS max FROM events WHERE event_id % 7 <> 0 AND event_type = 'click'"),
}


def middle(events: DataFrame) -> int:
    """The event_id in the middle, found by counting: no rows come to the driver, as a sort with an offset would send them."""
    at = F.col("event_id").cast("long").alias("at")
    low, high, many = events.select(at).agg(F.min("at"), F.max("at"), F.count("at")).first()
    return position_bound(events.select(at), low, high, many // 2 + 1, False)[0] if many else 0


def appended(lines: DataFrame, path: str, folder: str) -> None:
    """Appends the lines of ``lines`` (event_id, line) to the log at ``path``, in order: written by the executors, put one after another as bytes."""
    parts = f"{folder}/lines-{uuid.uuid4().hex}"
    lines.orderBy("event_id").select("line").write.option("lineSep", "\n").text(parts)
    local = urlsplit(parts).path
    with open(path, "ab") as log:
        for name in sorted(n for n in os.listdir(local) if n.startswith("part-")):  # numbered in the order of the sort
            with open(f"{local}/{name}", "rb") as part:
                shutil.copyfileobj(part, log, 1 << 20)
    shutil.rmtree(local)


def watched(text: str, most: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """The query on a watched log, read in several batches, rotated once and watched again by a new Watch.

    The log is a file where the driver runs, in the shared folder, as a tailed log is in one place.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = fresh_folder(spark, "watch")
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        lines = events.select("event_id", F.to_json(F.struct("event_id", "event_type", "value")).alias("line"))
        local = urlsplit(folder).path
        os.makedirs(local)
        path, state = f"{local}/app.log", f"{local}/state"
        later = F.coalesce(F.col("event_id") >= middle(events), F.lit(False))  # no id is before all others
        appended(lines.where(~later), path, folder)
        with open(path, "a", encoding="utf-8") as file:
            file.write('{"event_id":-1,')
        # Eight batches, or as many as take 16 MB each: else they'd grow with the log.
        batch = min(16 << 20, max(256 << 10, os.stat(path).st_size // 8))
        Watch(spark, path, state=state, every=None, max_bytes=batch)
        # Lines that come after the torn one is completed, a rotation, and a restart.
        with open(path, "a", encoding="utf-8") as file:
            file.write("\n")
        os.rename(path, f"{path}.1")
        appended(lines.where(later), path, folder)
        found = Watch(spark, path, state=state, every=None, max_events=most, max_bytes=max(1 << 20, batch)).query(text)
        return found if "raw" not in found.columns else found.select(F.try_variant_get("v", "$.event_id", "bigint").alias("event_id"))

    return run


#: Over a watched log: (query text, newest events that count (None: all), whole SQL).
WATCHED: dict[str, tuple[str, int | None, str]] = {
    "watch_count": ("| count", None, "SELECT count(*) AS count FROM events"),
    "watch_filter": ("event_type = error AND value > 100", None, f"SELECT event_id FROM events WHERE event_type = 'error' AND {_F('value')} > {_F(100)}"),
    "watch_retained": ("event_type = view", 1000, "SELECT event_id FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 1000) WHERE event_type = 'view'"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: typed(name) for name in TYPED}
    found |= {name: dynamic(text, props_lines, None) for name, (text, _) in DYNAMIC.items()}
    found |= {name: dynamic(text, event_lines, "at") for name, (text, _) in LINES.items()}
    found |= {name: json_lines(text) for name, (text, _) in FILES.items()}
    found |= {name: watched(text, most) for name, (text, most, _) in WATCHED.items()}
    return found | {"retention": retention, "follow": follow}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, (source, _, sql) in TYPED.items():
        columns = TABLES[source][2]
        found[name] = sql.replace("{columns}", columns) if sql.startswith("SELECT") else f"SELECT {columns} FROM {source} WHERE {sql}"
    found |= {name: sql for name, (_, sql) in {**DYNAMIC, **LINES, **FILES}.items()}
    found |= {name: sql for name, (_, _, sql) in WATCHED.items()}
    found["retention"] = "SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 1000) WHERE event_type = 'error'"
    found["follow"] = f"SELECT event_id, value FROM events WHERE event_type = 'error' AND {_F('value')} > {_F(50)}"
    return found
