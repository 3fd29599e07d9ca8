"""Following a growing log: a streaming source by byte offset, and an incremental analysis of its batches."""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.timefmt import Family, epoch_ms
from ..operators.ingest import AnalysedLog, ParsingConfig, analyse, append
from ..sources.spool import undone_if_failed
from ..sources.text import RANGE_BYTES, FileChange, FileState, decoded, numbered, range_lines
from ..sources.versions import LogFolder

#: Bytes before an offset that are checked.
SEEN_BYTES = 1 << 16
SCHEMA = StructType([StructField("doc_id", StringType()), StructField("block", LongType()), StructField("nth", LongType()), StructField("text", StringType())])


@dataclass
class ByteRange(InputPartition):
    """Lines that begin from byte ``lo`` up to ``hi``; the batch begins at ``start``, with a line."""

    start: int
    lo: int
    hi: int


class TailReader(DataSourceStreamReader):
    """Whole lines between two byte offsets, read by as many tasks as there are ranges of bytes; an unfinished last line is
    held back. The driver reads no more than the end of the file and the bytes that it checks: a file that shrinks, or whose
    bytes before an offset are others than when they were read, raises, as it has to be read anew with a new checkpoint.
    (Offsets carry a checksum of the last ``SEEN_BYTES`` before them; an edit further up isn't seen.)"""

    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def initialOffset(self) -> dict:
        return {"byte": 0, "seen": 0}

    @staticmethod
    def _seen(f: BinaryIO, at: int) -> int:
        f.seek(max(0, at - SEEN_BYTES))
        return zlib.crc32(f.read(min(at, SEEN_BYTES)))

    @staticmethod
    def _last_end(f: BinaryIO, size: int) -> int:
        """The byte after the last line feed."""
        at = size
        while at > 0:
            lo = max(0, at - SEEN_BYTES)
            f.seek(lo)
            found = f.read(at - lo).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            at = lo
        return 0

    def latestOffset(self) -> dict:
        size = os.path.getsize(self.path)
        with open(self.path, "rb") as f:
            end = self._last_end(f, size)
            return {"byte": end, "seen": self._seen(f, end)}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        a, b = start["byte"], end["byte"]
        if b < a or os.path.getsize(self.path) < b:
            raise ValueError(f"{self.path} has shrunk; a full reload is required")
        with open(self.path, "rb") as f:
            if self._seen(f, a) != start["seen"]:
                raise ValueError(f"{self.path} was modified in place; a full reload is required")
        return [ByteRange(a, lo, min(b, lo + self.range_bytes)) for lo in range(a, b, self.range_bytes)]

    def read(self, partition: ByteRange):
        lines = range_lines(self.path, partition.start, partition.lo, partition.hi)
        n = len(lines)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([self.path] * n), pa.array([partition.lo] * n, pa.int64()), pa.array(range(n), pa.int64()), decoded(lines)], [f.name for f in SCHEMA])


class TailSource(DataSource):
    """``spark.readStream.format("lumberline-tail").option("path", ...).option("range_bytes", ...)``"""

    @classmethod
    def name(cls) -> str:
        return "lumberline-tail"

    def schema(self) -> StructType:
        return SCHEMA

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def tail(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of (doc_id, block, nth, text) of a growing file that all executors see: the range of bytes that a line begins
    in, by its first byte, and the line's place there. ``numbered`` makes numbers of them in a batch."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format(TailSource.name()).option("path", path).option("range_bytes", range_bytes).load()


def check_change(path: str, before: FileState) -> FileChange:
    """What happened to a file; raises if it can't be followed any more."""
    change = before.change(FileState.of(path))
    if change in (FileChange.SHRUNK, FileChange.MODIFIED):
        raise ValueError(f"{path} was {change.value} in place; a full reload is required")
    return change


def minute_counts(stream: DataFrame, family: Family, watermark: str = "10 minutes") -> DataFrame:
    """(minute, cnt): lines by minute of their own time, in a stream; late lines count up to the watermark."""
    ts = F.timestamp_millis(epoch_ms(F.col("text"), family)).alias("ts")
    return stream.select(ts).where("ts is not null").withWatermark("ts", watermark).groupBy(F.window("ts", "60 seconds").alias("w")).agg(F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("minute"), "cnt")


class TailAnalysis:
    """A log that a stream of its lines keeps adding to, in a folder of versions.

    Use with ``tail(...)`` and ``writeStream.foreachBatch(analysis.batch)``. The first batch with lines is analysed like a file
    (format, time family, header, templates); every further one is appended: numbered, parsed, filled on from the last time
    and mined on in parallel from the clusters and children that are known, so templates are those of one load of all lines.
    All state is in the folder's last version, with the batch that made it: a restarted query goes on from there, a batch
    that comes again is left out, one that was cut short left nothing, and readers see whole batches only. The driver keeps no
    plans. Work follows a batch's lines, and the tables of templates and chunks.
    """

    def __init__(self, spark: SparkSession, folder: str, config: ParsingConfig = ParsingConfig(), keep: int = 3, **more):
        self.versions, self.config, self.keep, self.more = LogFolder(spark, folder, **{k: v for k, v in more.items() if k == "formats"}), config, keep, more

    def batch(self, df: DataFrame, batch_id: int) -> None:
        known = self.versions.versions()
        log, note = self.versions.open() if known else (None, {"batch": -1})
        if batch_id <= note["batch"]:
            return
        first = log.stored.count() if log else 0
        with self.versions.writing(), undone_if_failed():
            lines = numbered(df, first)
            if lines.limit(1).count() == 0:
                return
            now = append(log, lines) if log else analyse(lines, self.config, **self.more)
            self.versions.commit(now, {"batch": batch_id}, known[-1] if known else 0)
        if len(known) > 2 * self.keep:
            self.versions.clean(self.keep)

    @property
    def log(self) -> AnalysedLog | None:
        """The log as the last batch left it."""
        return self.versions.open()[0] if self.versions.versions() else None
