"""python -m tracequarry.cli --watch FILE [options] QUERY

With a data folder (by default one of the user's own), the log's lines and how far they were read are
kept there, so a second call reads what is new alone; ``--no-persist`` reads the file itself each time.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .session import AggregationError, ParseError, from_jsonl
from .sources.jsonl import MalformedLine
from .streaming.watch import Watch, follow


def options() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tracequarry")
    parser.add_argument("-w", "--watch", required=True, help="the log file")
    parser.add_argument("--time-field", help="field with RFC 3339 times")
    parser.add_argument("--max-events", type=int, default=2_000_000, help="newest events that count")
    parser.add_argument("--strict", action="store_true", help="fail at the first malformed line")
    parser.add_argument("--data-dir", help="folder of the durable state")
    parser.add_argument("--no-persist", action="store_true", help="keep no state")
    parser.add_argument("--interval", default="1 second", help="how often --follow looks for new lines")
    parser.add_argument("-f", "--follow", action="store_true", help="print new matching lines until stopped")
    parser.add_argument("query")
    return parser


def main(args: list[str] | None = None) -> int:
    given = options().parse_args(args)
    spark = SparkSession.builder.appName("tracequarry").getOrCreate()
    try:
        if given.follow:
            follow(spark, given.watch, given.query, printed, given.time_field, every=given.interval).awaitTermination()
        elif given.no_persist:
            print(from_jsonl(spark, given.watch, given.time_field, given.strict).retained(given.max_events).answer(given.query))
        else:
            watch = Watch(spark, given.watch, given.time_field, given.data_dir, None, given.max_events, given.strict)
            print(watch.answer(given.query))
    except KeyboardInterrupt:
        return 0
    except (ParseError, AggregationError, MalformedLine, FileNotFoundError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


def printed(rows, _) -> None:
    """Row by row, so the driver holds one partition at a time."""
    for row in rows.orderBy("_pos").select("raw").toLocalIterator():
        print(row.raw, flush=True)


if __name__ == "__main__":
    sys.exit(main())
