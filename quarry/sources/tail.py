"""A streaming source that follows a growing text file by byte offset.

Only whole lines are read, a last partial one waits for its end. A file that has become shorter was rotated and is
read from its beginning. Batches have a size limit, and Spark takes the next one when it is ready: nothing is dropped.
Offsets live in the query's checkpoint, so a restart goes on where it was. The path must be readable by the driver
and by executors alike (shared storage).
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a batch at most, and of one partition.
BATCH, SLICE = 64 << 20, 8 << 20


class Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _line_end(path: str, start: int, limit: int) -> int:
    """The end of the last whole line between start and start + limit; a longer line is taken whole."""
    with open(path, "rb") as f:
        f.seek(start)
        block = f.read(limit)
        cut = block.rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        if len(block) < limit:
            return start
        at = start + len(block)
        while more := f.read(1 << 16):
            k = more.find(b"\n")
            if k >= 0:
                return at + k + 1
            at += len(more)
    return start


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.from_end = options.get("startingPosition", "beginning") == "end"
        self.last = int(options.get("lines", "0"))
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict[str, int]:
        size = os.path.getsize(self.path) if os.path.exists(self.path) else 0
        start = size if self.from_end or self.last else 0
        if self.last and size:
            start = self._back(size, self.last)
        return {"pos": start, "turn": 0}

    def _back(self, size: int, lines: int) -> int:
        with open(self.path, "rb") as f:
            at, found = size, 0
            while at > 0:
                step = min(1 << 16, at)
                f.seek(at - step)
                block = f.read(step)
                for k in range(len(block) - 1, -1, -1):
                    if block[k] == 10 and at - step + k + 1 < size:
                        found += 1
                        if found == lines:
                            return at - step + k + 1
                at -= step
        return 0

    def latestOffset(self) -> dict[str, int]:
        now = self.at or self.initialOffset()
        if not os.path.exists(self.path):
            return now
        size = os.path.getsize(self.path)
        if size < now["pos"]:
            now = {"pos": 0, "turn": now["turn"] + 1}
        end = _line_end(self.path, now["pos"], BATCH)
        self.at = {"pos": end, "turn": now["turn"]}
        return self.at

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> Sequence[InputPartition]:
        self.at = end
        low = start["pos"] if start["turn"] == end["turn"] else 0
        out = []
        while low < end["pos"]:
            high = _line_end(self.path, low, SLICE)
            high = min(high, end["pos"]) if high > low else end["pos"]
            out.append(Slice(self.path, low, high))
            low = high
        return out

    def read(self, partition: Slice) -> Iterator[tuple[str, int]]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            for line in f.read(partition.end - partition.start).split(b"\n")[:-1]:
                yield line.decode("utf-8", "replace").rstrip("\r"), at
                at += len(line) + 1


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string, pos long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)


def follow(spark: SparkSession, path: str, from_end: bool = False, lines: int = 0):
    """A streaming DataFrame (value, pos) of the file's lines: all, new ones only, or the last ``lines`` and new ones."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("startingPosition", "end" if from_end else "beginning").option("lines", str(lines)).load(path)
