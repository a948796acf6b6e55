"""A data source for recorded feed frames: a folder to which a feed's client appends lines, each a frame of messages.

Offsets are bytes by file, so a stream goes on where it was stopped, reads a batch again as it was, and takes up what has
been appended to a file it has read before. A line is taken once its end has been written.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from driftwatch.sources.files import messages

FORMAT, SCHEMA = "driftwatch_frames", "value string, file string, start bigint"


@dataclass
class Lines(InputPartition):
    """Lines of a file that start from one byte up to another."""

    path: str
    file: str
    start: int
    end: int


def whole_lines(path: str) -> int:
    """The byte after the last end of a line."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        while size > 0:
            at = max(0, size - 65_536)
            f.seek(at)
            found = f.read(size - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            size = at
    return 0


def lines_of(part: Lines) -> Iterator[tuple[str, str, int]]:
    """A line that starts before the part's first byte belongs to another part."""
    with open(f"{part.path}/{part.file}", "rb") as f:
        f.seek(max(0, part.start - 1))
        if part.start:
            f.readline()  # up to the end of the line that holds the byte before
        while (at := f.tell()) < part.end:
            yield f.readline().decode("utf-8", "replace").rstrip("\r\n"), part.file, at


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.path, self.bytes = options["path"].removeprefix("file://"), int(options.get("partitionBytes", 64 << 20))

    def _ends(self) -> dict[str, int]:
        return {name: whole_lines(f"{self.path}/{name}") for name in sorted(os.listdir(self.path)) if not name.startswith((".", "_"))}

    def _between(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        return [Lines(self.path, name, at, min(to, at + self.bytes)) for name, to in end.items() for at in range(start.get(name, 0), to, self.bytes)]


class FrameReader(_Reader, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self._between({}, self._ends())

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return lines_of(partition)


class FrameStreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self._between(start, end)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return lines_of(partition)

    def commit(self, end: dict) -> None:
        pass


class Frames(DataSource):
    """Options: path, a folder that all executors see under that name; partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FrameStreamReader(self.options)


def frames(spark: SparkSession, folder: str, stream: bool = True, partition_bytes: int = 64 << 20) -> DataFrame:
    """value, file and start of each line of the folder's files."""
    spark.dataSource.register(Frames)
    reader = spark.readStream if stream else spark.read
    return reader.format(FORMAT).option("partitionBytes", partition_bytes).load(folder)


def frame_messages(spark: SparkSession, folder: str, stream: bool = True, partition_bytes: int = 64 << 20) -> DataFrame:
    """Trades and quotes of recorded frames, for detect_in_event_time or, stream being false, detect. seq is the byte at
    which a message's line starts plus its place in the frame. Error frames, other messages and malformed lines are skipped."""
    return messages(frames(spark, folder, stream, partition_bytes), "start")
