"""Log files that others append to, read by byte offsets: whole lines only, so many bytes to a task, and from the start
again where a file was replaced or cut."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cairnlight.sources.scratch import local_path

#: Fixed value: bytes of a file read in one poll.
POLL_BYTES = 4 * 1024 * 1024


def complete_end(path: str, start: int, most: int) -> int:
    """Where the last whole line ends that lies within ``most`` bytes of ``start``; a longer line goes whole, an unfinished
    one is left for later."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        stop = min(size, start + most)
        while stop > start:
            low = max(start, stop - 65_536)
            f.seek(low)
            cut = f.read(stop - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            stop = low
        # No line ends within the limit: the next one to end goes whole.
        f.seek(min(size, start + most))
        while chunk := f.read(65_536):
            cut = chunk.find(b"\n")
            if cut >= 0:
                return f.tell() - len(chunk) + cut + 1
    return start


@dataclass
class _Bytes(InputPartition):
    path: str
    start: int
    stop: int
    head: bool


@dataclass(frozen=True)
class _Mark:
    """How far a file was read: which file it is, how often it was cut, and the bytes."""

    identity: str
    cuts: int
    at: int

    @classmethod
    def of(cls, text: str | None) -> _Mark | None:
        return cls(*(kind(x) for kind, x in zip((str, int, int), text.split(":"), strict=True))) if text else None

    def __str__(self) -> str:
        return f"{self.identity}:{self.cuts}:{self.at}"


class LogReader(DataSourceStreamReader):
    """Offsets are marks by file. A poll takes ``poll_bytes`` of each file, counted from the end planned last.

    A query that goes on plans its last batch before it asks for more; one that asks at once is new.
    """

    def __init__(self, pattern: str, poll_bytes: int) -> None:
        self.pattern, self.poll_bytes = pattern, poll_bytes
        self.reached: dict[str, str] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = dict(self.reached)
        for path in sorted(glob.glob(self.pattern)):
            try:
                stat = os.stat(path)
                identity = f"{stat.st_dev}-{stat.st_ino}"
                last = _Mark.of(self.reached.get(path)) or _Mark(identity, 0, 0)
                if last.identity != identity or last.at > stat.st_size:
                    last = _Mark(identity, last.cuts + 1, 0)
                out[path] = str(_Mark(identity, last.cuts, complete_end(path, last.at, self.poll_bytes)))
            except FileNotFoundError:
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[_Bytes]:
        out = []
        for path, text in end.items():
            stop, begun = _Mark.of(text), _Mark.of(start.get(path))
            low = begun.at if begun and (begun.identity, begun.cuts) == (stop.identity, stop.cuts) else 0
            out += [_Bytes(path, k, min(k + self.poll_bytes, stop.at), k == low) for k in range(low, stop.at, self.poll_bytes)]
        self.reached = dict(end)
        return out

    def read(self, part: _Bytes) -> Iterator[tuple]:
        """Lines that begin within the bytes of a partition."""
        with open(part.path, "rb") as f:
            if not part.head:
                f.seek(part.start - 1)
                f.readline()
            else:
                f.seek(part.start)
            while (at := f.tell()) < part.stop:
                line = f.readline()
                yield part.path, at, line.rstrip(b"\n").decode("utf-8", "replace")


class LogSource(DataSource):
    """``log_tail``: (path, offset, line) of the whole lines of all files that match ``path``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def streamReader(self, schema) -> LogReader:  # noqa: ANN001
        return LogReader(self.options["path"], int(self.options.get("poll_bytes", POLL_BYTES)))


def follow(spark: SparkSession, pattern: str, poll_bytes: int = POLL_BYTES) -> DataFrame:
    """Stream of the lines of log files on a file system that all executors mount."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("log_tail").option("path", local_path(pattern)).option("poll_bytes", poll_bytes).load()
