"""Logs that grow, as a stream: what is added to files comes once, in whole lines."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.sources import stores

#: Bytes that are looked through at a time for the last line's end.
_BLOCK = 1 << 16
#: What a file costs a task besides its bytes, in bytes.
_OPENING = 1 << 20


@dataclass
class Part:
    """Lines of a file that start from low to high; all of them end at ``end`` or before. ``low`` begins a line, or is inside one if ``inside``."""

    name: str
    low: int
    high: int
    end: int
    inside: bool


@dataclass
class Share(InputPartition):
    """What one task reads: a part of a long file, or parts of many short ones."""

    parts: list[Part]


def whole_lines(source, size: int) -> int:
    """Where the last whole line of so many bytes ends."""
    at = size
    while at > 0:
        start = max(0, at - _BLOCK)
        source.seek(start)
        found = source.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


class LogReader(DataSourceStreamReader):
    """Offsets are bytes by file. A file that has become shorter is a new one, and is read from its start."""

    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.split = options["path"], options.get("pattern", "*"), int(options.get("split", 64 << 20))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, folder = stores.of(self.path)
        out = {}
        for name, size in stores.names(system, folder).items():
            if fnmatch.fnmatch(name, self.pattern):
                with system.open_input_file(f"{folder}/{name}") as source:
                    out[name] = whole_lines(source, size)
        return out

    def partitions(self, start: dict, end: dict) -> list[Share]:
        out, room = [], 0
        for name, stop in sorted(end.items()):
            first = start.get(name, 0)
            first = first if first <= stop else 0
            for low in range(first, stop, self.split):
                part = Part(name, low, min(low + self.split, stop), stop, low > first)
                cost = part.high - part.low + _OPENING
                if cost > room:
                    out.append(Share([]))
                    room = self.split
                out[-1].parts.append(part)
                room -= cost
        return out

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        for part in share.parts:
            yield from self._lines(part)

    def _lines(self, part: Part) -> Iterator[pa.RecordBatch]:
        with stores.open_input(f"{self.path}/{part.name}") as source:
            at = part.low - part.inside  # a line starts after a line's end
            source.seek(at)
            held = b""
            skip = part.inside
            while at < part.end:
                block = source.read(min(_BLOCK, part.end - at))
                if not block:
                    raise ValueError(f"{part.name} became shorter while it was read")
                begin, data = at - len(held), held + block
                at += len(block)
                lines = data.split(b"\n")
                held = lines.pop()
                places, texts = [], []
                for line in lines:
                    if begin >= part.high:
                        break
                    if not skip:
                        places.append(begin)
                        texts.append(line.removesuffix(b"\r").decode(errors="replace"))
                    skip = False
                    begin += len(line) + 1
                if places:
                    yield pa.RecordBatch.from_arrays([pa.array([part.name] * len(places)), pa.array(places, pa.int64()), pa.array(texts)], ["file", "position", "line"])
                if begin >= part.high:
                    return


class LogSource(DataSource):
    """Options: path (a folder), pattern (of file names), split (bytes to a task)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_log"

    def schema(self) -> str:
        return "file string, position long, line string"

    def streamReader(self, schema) -> LogReader:  # noqa: N802
        return LogReader(self.options)


def follow(spark: SparkSession, path: str, pattern: str = "*", split: int = 64 << 20) -> DataFrame:
    """(file, position, line) of a folder's logs as a stream: lines that are there, and those added later.

    A line without its end waits for it. Lines keep their order by (file, position), the byte where
    each starts. Long additions are read by several tasks.
    """
    spark.dataSource.register(LogSource)
    return spark.readStream.format("tidemark_log").option("path", path).option("pattern", pattern).option("split", str(split)).load()
