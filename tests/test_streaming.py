import os
import time

import pytest

from tracequarry.sources.logtail import RangeLost, TailReader
from tracequarry.streaming.watch import Watch, follow


def test_tail_reader_torn_lines_rotation_and_replay(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b'{"a":1}\n{"b":')
    reader = TailReader(str(path), "earliest", 1 << 20)
    first = reader.initialOffset()
    rows, at = reader.read(first)
    assert [r[1] for r in rows] == ['{"a":1}'] and at["byte"] == 8
    with path.open("ab") as f:
        f.write(b"2}\n")
    rows, later = reader.read(at)
    assert [r[1] for r in rows] == ['{"b":2}'] and list(reader.readBetweenOffsets(first, later))[1][1] == '{"b":2}'
    os.rename(path, tmp_path / "old")
    path.write_bytes(b'{"c":3,"longer than before":"............"}\n')
    rows, turned = reader.read(later)
    assert [r[1][:6] for r in rows] == ['{"c":3'] and turned["generation"] == 1
    path.write_bytes(b"x\n")
    rows, cut = reader.read(turned)
    assert [r[1] for r in rows] == ["x"] and cut["generation"] == 2
    path.unlink()
    assert list(reader.read(cut)[0]) == [] and reader.read(cut)[1] == cut
    assert TailReader(str(path), "latest", 10).initialOffset()["byte"] == 0


def test_small_batches_hold_whole_lines(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"a" * 50 + b"\nb\nc\n")
    reader = TailReader(str(path), "earliest", 7)
    at, lines = reader.initialOffset(), []
    for _ in range(5):
        rows, at = reader.read(at)
        lines += [r[1] for r in rows]
    assert lines == ["a" * 50, "b", "c"]


def test_watch_restarts_exactly_and_rewatches(spark, tmp_path):
    path, state = tmp_path / "a.log", str(tmp_path / "state")
    path.write_text('{"n":1}\nbad\n{"n":1,"n":2}\n')
    watch = Watch(spark, str(path), state=state, every=None)
    assert watch.answer("| count") == "2"
    with path.open("a") as f:
        f.write('{"n":3}\n{"n":')
    again = Watch(spark, str(path), state=state, every=None)
    assert again.answer("| sum n") == "6" and again.answer("| tail 1") == '{"n":3}'
    other = tmp_path / "b.log"
    other.write_text('{"m":9}\n')
    again.rewatch(str(other))
    assert again.answer("| max m") == "9"
    again.stop()


def test_follow_sees_new_matching_lines_alone(spark, tmp_path):
    path, seen = tmp_path / "a.log", []
    path.write_text('{"level":"ERROR","n":0}\n')
    running = follow(spark, str(path), "level = ERROR", lambda rows, _: seen.extend(r.raw for r in rows.collect()), every="200 milliseconds")
    try:
        running.processAllAvailable()
        with path.open("a") as f:
            f.write('{"level":"INFO","n":1}\n{"level":"ERROR","n":2}\n')
        until = time.time() + 60
        while not seen and time.time() < until:
            running.processAllAvailable()
            time.sleep(0.2)
        assert seen == ['{"level":"ERROR","n":2}']
    finally:
        running.stop()


def drained(reader, at):
    lines = []
    while True:
        rows, later = reader.read(at)
        rows = list(rows)
        if not rows and later == at:
            return lines, at
        lines += [r[1] for r in rows]
        at = later


def test_rotation_loses_no_line(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"1\n2\n3\n4\n")
    reader = TailReader(str(path), "earliest", 4)
    first = reader.initialOffset()
    rows, at = reader.read(first)
    assert [r[1] for r in rows] == ["1", "2"]
    os.rename(path, tmp_path / "a.log.1")
    path.write_bytes(b"5\n")
    # What the renamed file still holds comes first, then the new one; positions rise.
    lines, end = drained(reader, at)
    assert lines == ["3", "4", "5"] and end["generation"] == 1
    # A range that was read before the rotation is read from the renamed file.
    assert [r[1] for r in reader.readBetweenOffsets(first, at)] == ["1", "2"]
    (tmp_path / "a.log.1").unlink()
    with pytest.raises(RangeLost):
        reader.readBetweenOffsets(first, at)
    assert [r[1] for r in reader.readBetweenOffsets(at, end)] == ["5"]
    path.write_bytes(b"")
    with pytest.raises(RangeLost):
        reader.readBetweenOffsets(at, end)


def test_stop_and_torn_lines(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"1\n22\n")
    reader = TailReader(str(path), "earliest", 3, (path.stat().st_ino, 5))
    with path.open("ab") as f:
        f.write(b"later\n")
    assert drained(reader, reader.initialOffset())[0] == ["1", "22"]
    torn = tmp_path / "torn.log"
    torn.write_bytes(b"x" * 5_000_000)
    reader = TailReader(str(torn), "earliest", 10)
    assert drained(reader, reader.initialOffset())[0] == []
    with torn.open("ab") as f:
        f.write(b"y\nz\n")
    assert [len(x) for x in drained(reader, reader.initialOffset())[0]] == [5_000_001, 1]


def test_one_shot_takes_the_whole_file(spark, tmp_path):
    path, state = tmp_path / "a.log", str(tmp_path / "state")
    path.write_text("".join(f'{{"n":{i}}}\n' for i in range(3000)))
    watch = Watch(spark, str(path), state=state, every=None, max_bytes=9000)
    assert watch.answer("| count") == "3000" and watch.answer("| tail 1") == '{"n":2999}'
    # Rotated and restarted: the rest of the renamed file and the new one.
    with path.open("a") as f:
        f.write('{"n":3000}\n')
    os.rename(path, tmp_path / "a.log.1")
    path.write_text('{"n":3001}\n')
    again = Watch(spark, str(path), state=state, every=None, max_bytes=9000, max_events=1000)
    assert again.answer("| count") == "1000" and again.answer("| min n") == "2002" and again.answer("| max n") == "3001"


def events_of(spark, tmp_path, rows):
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_watched_log_is_written_without_the_driver(spark, tmp_path, monkeypatch):
    from tracequarry.queries import middle, queries

    folder = events_of(spark, tmp_path, [(i if i % 100 else None, "view", float(i)) for i in range(3000)])
    assert middle(spark.read.parquet(f"{folder}/events.parquet")) == 1501  # of 1 to 2999 without the hundreds

    def refused(self, *args, **kwargs):
        raise AssertionError("rows of the log come to the driver")

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", refused)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.offset", refused)
    found = queries()["watch_retained"](spark, folder)
    # The newest 1000 events; rows without an id are before all others.
    assert sorted(r.event_id for r in found.collect()) == [i for i in range(3000) if i % 100][-1000:]


@pytest.mark.parametrize("name", ["watch_filter", "watch_count"])
def test_whole_log_counts_where_the_sql_has_no_bound(spark, tmp_path, name):
    from tracequarry.queries import WATCHED

    path = tmp_path / "a.log"
    path.write_text('{"event_type":"error","value":101}\n' * 3)
    text, most, sql = WATCHED[name]
    assert most is None and "LIMIT" not in sql
    watch = Watch(spark, str(path), state=str(tmp_path / "state"), every=None, max_events=most)
    assert watch.query("| count").first()[0] == 3 and watch.query(text).count() == (1 if "|" in text else 3)
