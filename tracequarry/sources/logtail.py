"""A streaming source that tails a growing file by byte offset.

Offsets are {generation, inode, byte}. A new inode, or a file shorter than the offset, begins a new
generation at byte 0, also if that happened while no query ran; what a renamed file still holds is
read before that, if it stays in its folder. A last line without a line feed waits, at the cost of a
scan without keeping it. A micro-batch reads at most ``maxBytes`` (at least one line).

A range can be read again: it is looked up by its inode, in the file's folder. If the file is gone or
was cut, the replay raises ``RangeLost``; it never returns fewer lines than it did at first. A file
that was cut and grew beyond the offset again between two reads can't be told from one that grew.

The file is read where the driver runs, as a log that is being written is in one place; whole files
are read in parallel by ``read_jsonl``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Generations take the bits above the byte offset in _pos.
GENERATION_BITS = 48
#: Bytes that one step of a scan for a line's end reads; a longer line than LONGEST_LINE raises.
STEP, LONGEST_LINE = 1 << 20, 1 << 30


class RangeLost(RuntimeError):
    """A byte range that was read once isn't there any more."""


class LineTooLong(ValueError):
    """A line has more than LONGEST_LINE bytes."""


class TailReader(SimpleDataSourceStreamReader):
    """``stop``: (inode, byte) beyond which nothing is read; None: no end."""

    def __init__(self, path: str, start: str, most: int, stop: tuple[int, int] | None = None):
        self.path, self.start, self.most, self.stop = path, start, most, stop

    def initialOffset(self) -> dict:
        try:
            found = os.stat(self.path)
        except FileNotFoundError:
            return {"generation": 0, "inode": 0, "byte": 0}
        return {"generation": 0, "inode": found.st_ino, "byte": self.last_line_end() if self.start == "latest" else 0}

    def last_line_end(self) -> int:
        with open(self.path, "rb") as file:
            at = file.seek(0, os.SEEK_END)
            while at:
                size = min(1 << 16, at)
                file.seek(at - size)
                cut = file.read(size).rfind(b"\n")
                if cut >= 0:
                    return at - size + cut + 1
                at -= size
        return 0

    def file_of(self, inode: int) -> str | None:
        """Where the file with that inode is now: at the path, or beside it under another name."""
        try:
            if os.stat(self.path).st_ino == inode:
                return self.path
            with os.scandir(os.path.dirname(os.path.abspath(self.path))) as entries:
                return next((e.path for e in entries if e.inode() == inode and e.is_file()), None)
        except FileNotFoundError:
            return None

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = dict(start)
        try:
            found = os.stat(self.path)
        except FileNotFoundError:
            found = None
        if at["inode"] and (found is None or found.st_ino != at["inode"]):
            old = self.file_of(at["inode"])
            rows, end = self.lines(old, at["generation"], at["byte"], None) if old else ([], at["byte"])
            if rows or found is None:
                return iter(rows), at | {"byte": end}
            at = {"generation": at["generation"] + 1, "inode": found.st_ino, "byte": 0}
        elif found is None:
            return iter(()), start
        elif found.st_size < at["byte"]:
            at = {"generation": at["generation"] + 1, "inode": found.st_ino, "byte": 0}
        at["inode"] = found.st_ino
        limit = None
        if self.stop:
            if found.st_ino != self.stop[0] or at["byte"] >= self.stop[1]:
                return iter(()), start
            limit = self.stop[1]
        rows, end = self.lines(self.path, at["generation"], at["byte"], limit)
        return (iter(rows), at | {"byte": end}) if rows or at["generation"] != start["generation"] or not start["inode"] else (iter(()), start)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        begin = start["byte"] if start["generation"] == end["generation"] else 0
        path = self.file_of(end["inode"]) if end["byte"] > begin else None
        if end["byte"] == begin:
            return iter(())
        if path is None or os.stat(path).st_size < end["byte"]:
            raise RangeLost(f"bytes {begin} to {end['byte']} of {self.path} (inode {end['inode']}) can't be read again")
        with open(path, "rb") as file:
            file.seek(begin)
            data = file.read(end["byte"] - begin)
        if not data.endswith(b"\n"):
            raise RangeLost(f"bytes {begin} to {end['byte']} of {self.path} (inode {end['inode']}) aren't the lines that were read before")
        return iter(self.rows(data, end["generation"], begin))

    def rows(self, data: bytes, generation: int, at: int) -> list[tuple]:
        """(_pos, value) of the lines in ``data``, which ends with a line feed or is empty."""
        rows = []
        for line in data.split(b"\n")[:-1]:
            rows.append(((generation << GENERATION_BITS) + at, line.decode("utf-8", "replace")))
            at += len(line) + 1
        return rows

    def lines(self, path: str, generation: int, begin: int, limit: int | None) -> tuple[list[tuple], int]:
        """Complete lines from ``begin``, of at most ``most`` bytes or one line, up to byte ``limit``; and where they end."""
        with open(path, "rb") as file:
            file.seek(begin)
            room = self.most if limit is None else min(self.most, limit - begin)
            data = file.read(room)
            if b"\n" not in data and len(data) == self.most:
                # A line longer than a batch: its end is looked for before it is held.
                size, step = len(data), file.read(STEP)
                while step and b"\n" not in step:
                    size, step = size + len(step), file.read(STEP)
                    if size > LONGEST_LINE:
                        raise LineTooLong(f"the line at byte {begin} of {path} has more than {LONGEST_LINE} bytes")
                end = begin + size + step.find(b"\n") + 1
                if step and (limit is None or end <= limit):
                    file.seek(begin)
                    data = file.read(end - begin)
        data = data[: data.rfind(b"\n") + 1]
        return self.rows(data, generation, begin), begin + len(data)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """Options: path; startingOffset (earliest or latest); maxBytes; stopInode and stopByte."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return "_pos long, value string"

    def simpleStreamReader(self, schema) -> TailReader:
        stop = (int(self.options["stopInode"]), int(self.options["stopByte"])) if "stopInode" in self.options else None
        return TailReader(self.options["path"], self.options.get("startingOffset", "earliest"), int(self.options.get("maxBytes", 16 << 20)), stop)


def read_tail(spark: SparkSession, path: str, start: str = "earliest", max_bytes: int = 16 << 20, to_end: bool = False):
    """A streaming DataFrame of _pos and value; ``to_end``: up to where the file ends now."""
    spark.dataSource.register(TailSource)
    stream = spark.readStream.format("logtail").option("path", path).option("startingOffset", start).option("maxBytes", max_bytes)
    if to_end:
        found = os.stat(path) if os.path.exists(path) else None
        stream = stream.option("stopInode", found.st_ino if found else 0).option("stopByte", found.st_size if found else 0)
    return stream.load()
