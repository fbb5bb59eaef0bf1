"""Lines appended to growing log files, as a stream.

A position is the bytes of each file that are taken.  A new query starts at the end of the
files that are there, a restarted one where its checkpoint says; files that appear later
are read from their start, one that has become shorter (rotated in place) anew.  Only whole
lines are taken.  What is new is cut into ranges of bytes, so many or large files are read
by many tasks; the files must lie where driver and executors can open them.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a task's range, and bytes that are looked at for the end of the last whole line.
RANGE, BACK = 16 << 20, 1 << 16


@dataclass
class Piece(InputPartition):
    """Lines that start in [first, last) of a file; the last one may reach beyond."""

    path: str
    first: int
    last: int


def whole_lines(path: str, least: int = 0) -> int:
    """Bytes up to the end of the last whole line after ``least``."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end > least:
            start = max(least, end - BACK)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return least


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str, from_start: bool, range_bytes: int):
        self.pattern, self.from_start, self.range = pattern, from_start, range_bytes
        self.seen: dict[str, int] = {}

    def _now(self, before: dict[str, int]) -> dict[str, int]:
        out = {}
        for path in sorted(glob.glob(self.pattern)):
            try:
                size = os.path.getsize(path)
                have = before.get(path, 0)
                out[path] = whole_lines(path, have if have <= size else 0)
            except FileNotFoundError:  # rotated away meanwhile
                continue
        return out

    def initialOffset(self) -> dict:
        return {"files": json.dumps({} if self.from_start else self._now({}), sort_keys=True)}

    def latestOffset(self) -> dict:
        self.seen = self._now(self.seen)
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        pieces = []
        for path, last in after.items():
            first = before.get(path, 0)
            first = first if first <= last else 0
            pieces += [Piece(path, a, min(a + self.range, last)) for a in range(first, last, self.range)]
        return pieces or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple[str]]:
        if partition.first >= partition.last:
            return
        with open(partition.path, "rb") as f:
            at = partition.first
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the rest of a line that starts before
            while at < partition.last and (line := f.readline()):
                at += len(line)
                yield (line.rstrip(b"\r\n").decode("utf-8", "replace"),)

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    """Format ``tail``: options path (a glob), startingPosition (latest or earliest), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> TailReader:  # noqa: ANN001
        return TailReader(self.options["path"], self.options.get("startingposition", "latest") == "earliest", int(self.options.get("rangebytes", RANGE)))


def tail_lines(spark: SparkSession, pattern: str, from_start: bool = False) -> DataFrame:
    """Lines (``value``) that are appended to the files of ``pattern`` from now on."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").option("path", pattern).option("startingPosition", "earliest" if from_start else "latest").load()
