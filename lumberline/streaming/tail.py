"""Tails of growing files as a Structured Streaming source, and what is done with their batches.

Spark's own file source sees new files only; this one sees bytes appended to known ones.  The offset of a batch holds,
for each file, how many bytes and lines are done; whole lines only are handed out, so a line that is still being
written waits for its end.  A file that got shorter is read from its beginning.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lumberline.functions import logfields as lf

SCHEMA = "virtual_path string, line bigint, content string"


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int, first_line: int) -> None:
        self.path, self.start, self.end, self.first_line = path, start, end, first_line


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _whole(self, path: str, start: int) -> tuple[int, int]:
        """End of the last whole line after ``start``, and how many lines there are."""
        end, lines, at = start, 0, start
        with open(path, "rb") as f:
            f.seek(start)
            while block := f.read(1 << 20):
                lines += block.count(b"\n")
                if (k := block.rfind(b"\n")) >= 0:
                    end = at + k + 1
                at += len(block)
        return end, lines

    def latestOffset(self) -> dict:
        for root, _, names in os.walk(self.path):
            for n in sorted(names):
                p = os.path.join(root, n)
                if os.path.islink(p):
                    continue
                end, lines, turn = self.known.get(p, [0, 0, 0])
                if os.path.getsize(p) < end:
                    end, lines, turn = 0, 0, turn + 1
                new_end, more = self._whole(p, end)
                self.known[p] = [new_end, lines + more, turn]
        return {"files": {p: list(v) for p, v in self.known.items()}}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        out = []
        for p, (to, _, turn) in end["files"].items():
            a, line, old = start["files"].get(p, [0, 0, 0])
            if turn != old:
                a, line = 0, 0
            if to > a:
                out.append(_Part(p, a, to, line + 1))
        for p, v in end["files"].items():
            self.known.setdefault(p, list(v))
        return out

    def read(self, partition: _Part) -> Iterator[tuple[str, int, str]]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        for i, raw in enumerate(data.split(b"\n")[:-1]):
            yield partition.path, partition.first_line + i, raw.removesuffix(b"\r").decode("utf-8", "replace")


class TailSource(DataSource):
    """``spark.readStream.format("tail").option("path", directory)``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _TailReader:  # noqa: N802
        return _TailReader(self.options)


def tail(spark: SparkSession, path: str) -> DataFrame:
    """The lines appended to the files under ``path``, with their level and time."""
    spark.dataSource.register(TailSource)
    d = spark.readStream.format("tail").option("path", path).load()
    return lf.with_fields(d)


def append_to(lines: DataFrame, table: str, checkpoint: str, trigger: dict | None = None):
    """Start appending a stream of lines to a Parquet folder; returns the query."""
    return lines.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def level_counts(lines: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Lines by window of their own time and level, late ones within the watermark counted, too."""
    d = lines.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    return d.groupBy(F.window("event_time", window), "level").agg(F.count("*").alias("n"))
