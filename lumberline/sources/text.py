"""Text logs as tables of numbered lines, and generators of synthetic logs."""

from __future__ import annotations

import os
from dataclasses import dataclass
from enum import Enum

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Partitions of a reader up to which the counts of its splits are broadcast.
BROADCAST_SPLITS = 4_096


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(doc_id, line_no, text, n_bytes): every physical line of the files, numbered from 0 in file order.

    Lines end at line feeds; carriage returns at the end of a line are cut. Numbers need no global sort: Spark's splits
    are known by file and start, lines inside a split are in order, so a split's first number is the running total of
    the counts of the splits before it, and only those counts are shuffled. An empty file has no lines.
    """
    raw = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("doc_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.regexp_replace("value", "\r+$", "").alias("text"),
    )
    blocks = raw.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("doc_id", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    small = raw.rdd.getNumPartitions() <= BROADCAST_SPLITS  # one row for each split of 128 MB, or small file
    numbered = raw.join(F.broadcast(starts) if small else starts, ["doc_id", "block"])
    return numbered.select("doc_id", (F.col("start") + F.col("id") - F.col("first")).alias("line_no"), "text", F.octet_length("text").alias("n_bytes"))


def first_lines(spark: SparkSession, path: str, n: int) -> list[dict] | None:
    """The first ``n`` lines of one file ({"line_no", "text"}), from its first split alone; None if that has fewer."""
    split = spark.read.text(path, lineSep="\n").where("_metadata.file_block_start = 0")
    rows = split.select(F.regexp_replace("value", "\r+$", "").alias("text")).limit(n).collect()
    return [{"line_no": i, "text": r["text"]} for i, r in enumerate(rows)] if len(rows) == n else None


#: Bytes of a file that one task reads when a part of it is read.
RANGE_BYTES = 32 << 20


def range_lines(path: str, start: int, lo: int, hi: int) -> list[bytes]:
    """The lines of a file that begin from byte ``lo`` up to ``hi`` (not included); at ``start`` a line begins."""
    with open(path, "rb") as f:
        if lo > start:
            f.seek(lo - 1)
            f.readline()  # its line began before, or ends just here
        else:
            f.seek(lo)
        at = f.tell()
        if at >= hi:
            return []
        data = f.read(hi - at)
        if not data.endswith(b"\n"):
            data += f.readline()
    lines = data.split(b"\n")
    return lines[:-1] if not lines[-1] else lines


def decoded(lines: list[bytes]) -> pa.Array:
    return pa.array([x.rstrip(b"\r").decode("utf-8", "replace") for x in lines], pa.string())


def numbered(ranges: DataFrame, first_line: int) -> DataFrame:
    """(doc_id, line_no, text, n_bytes) of lines (doc_id, block, nth, text) that are counted within their ranges: a range's
    first number follows from the counts of those before, one row for each."""
    counts = ranges.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("doc_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranges.join(starts, ["doc_id", "block"]).select("doc_id", (F.lit(first_line) + F.col("start") + F.col("nth")).alias("line_no"), "text", F.octet_length("text").alias("n_bytes"))


def lines_from(spark: SparkSession, path: str, start: int, first_line: int, end: int, doc_id: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, line_no, text, n_bytes): the lines of a file from byte ``start``, where a line begins, to ``end``, numbered on
    from ``first_line``. Tasks read ranges of bytes and nothing before ``start`` is read; all executors must see the file."""
    name = doc_id or f"file://{os.path.abspath(path)}"
    n = max(1, -(-(end - start) // range_bytes))

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                lo = start + i * range_bytes
                lines = range_lines(path, start, lo, min(end, lo + range_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([lo] * len(lines), pa.int64()), pa.array(range(len(lines)), pa.int64()), decoded(lines)], ["block", "nth", "text"])

    found = spark.range(0, n, 1, n).mapInArrow(run, "block bigint, nth bigint, text string")
    return numbered(found.withColumn("doc_id", F.lit(name)), first_line)


def split_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, text, n_bytes): the lines of texts held in a table; a last empty line doesn't count."""
    lines = F.posexplode(F.split(F.regexp_replace(text_col, "\n$", ""), "\n"))
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), lines.alias("line_no", "text")).select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("text", "\r+$", "").alias("text")
    ).withColumn("n_bytes", F.octet_length("text"))


def forward_filled(df: DataFrame, value: str = "ts_raw_ms", out: str = "ts_ms", chunk: int = 65_536) -> DataFrame:
    """``df`` (doc_id, line_no, ...) with the last known ``value`` up to each line.

    A file is cut into chunks of lines; each chunk's last value is aggregated, carried over the chunks (one row each),
    and only inside a chunk are rows sorted. One long file is many tasks.
    """
    rows = df.withColumn("__chunk", F.floor(F.col("line_no") / chunk))
    last = rows.where(F.col(value).isNotNull()).groupBy("doc_id", "__chunk").agg(F.max_by(value, "line_no").alias("__last"))
    chunks = rows.select("doc_id", "__chunk").distinct().join(last, ["doc_id", "__chunk"], "left")
    before = Window.partitionBy("doc_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select("doc_id", "__chunk", F.last("__last", True).over(before).alias("__carried"))
    inside = Window.partitionBy("doc_id", "__chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.join(carried, ["doc_id", "__chunk"]).withColumn(out, F.coalesce(F.last(value, True).over(inside), F.col("__carried")))
    return filled.select(*df.columns, out)


class FileChange(Enum):
    UNCHANGED = "unchanged"
    APPENDED = "appended"
    SHRUNK = "shrunk"
    MODIFIED = "modified"


@dataclass(frozen=True)
class FileState:
    """Size and time of a local file when it was read."""

    size: int
    mtime_ns: int

    @classmethod
    def of(cls, path: str) -> FileState:
        s = os.stat(path)
        return cls(s.st_size, s.st_mtime_ns)

    def change(self, now: FileState) -> FileChange:
        """Size decides first, then the time."""
        if now.size != self.size:
            return FileChange.APPENDED if now.size > self.size else FileChange.SHRUNK
        return FileChange.UNCHANGED if now.mtime_ns == self.mtime_ns else FileChange.MODIFIED


def _pick(seed: int, salt: int, options: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.lit(seed * 1000 + salt), "id"), F.lit(len(options))) + 1).cast("int"))


# The words of the two synthetic logs.
BENCH_LEVELS = ["INFO", "DEBUG", "WARN", "ERROR"]
BENCH_EVENTS = [
    "request completed path=/api/users status=200",
    "db query took {n}ms sql=SELECT * FROM sessions",
    "cache miss for key user:{n}",
    "retry attempt {n} for job sync-photos",
    "connection timeout to backend-{n}:8443 after 3000ms",
    "ERROR unhandled exception in worker-{n}: NullPointerException",
    "payment authorized order_id=ORD-{n} amount=99.99",
    "user login user_id=42 session=sess-{n}",
]
IOS_LEVELS = ["ERROR"] * 5 + ["FAULT"] + ["WARNING"] * 10 + ["NOTICE"] * 14 + ["INFO"] * 45 + ["DEBUG"] * 25


def bench_log(spark: SparkSession, n: int) -> DataFrame:
    """(line_no, text): ``n`` lines of a server log, 37 ms apart; the first lines are the same for every ``n``."""
    ms = F.lit(1_752_000_000_000) + F.col("id") * 37
    level = F.element_at(F.array(*map(F.lit, BENCH_LEVELS)), ((F.expr("(id % 97) div 24") % 4) + 1).cast("int"))
    event = F.element_at(F.array(*map(F.lit, BENCH_EVENTS)), (F.col("id") % len(BENCH_EVENTS) + 1).cast("int"))
    event = F.replace(event, F.lit("{n}"), (F.col("id") % 7919).cast("string"))
    stamp = F.concat(F.lit("2025-07-13T"), F.date_format(F.timestamp_millis(ms), "HH:mm:ss.SSS"), F.lit("Z"))
    text = F.concat_ws(" ", stamp, level, F.concat(F.lit("worker-"), (F.col("id") % 8).cast("string")), event)
    return spark.range(n).select(F.col("id").alias("line_no"), text.alias("text"))


def ios_log(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(line_no, text): ``n`` lines in the shape of an iOS console log, by seeded hashes: 1 to 5 lines a second, times
    not in order inside a second; smaller logs are prefixes of larger ones."""
    second = F.expr("id div 3")
    micros = F.lpad(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)).cast("string"), 6, "0")
    stamp = F.concat(F.date_format(F.timestamp_seconds(F.lit(1_752_000_000) + second), "yyyy-MM-dd HH:mm:ss."), micros, F.lit("+0300"))
    process = _pick(seed, 2, ["12345", "12346", "12350", "12399"])
    thread = (F.pmod(F.xxhash64(F.lit(seed + 3), "id"), F.lit(16)) + 1).cast("string")
    source = _pick(seed, 4, [f"{x}{y}.swift:" for x in ("App", "Network", "Home", "Login", "Sync") for y in ("Delegate", "Manager", "View", "Store")])
    line = (F.pmod(F.xxhash64(F.lit(seed + 5), "id"), F.lit(300)) + 1).cast("string")
    message = _pick(seed, 6, ["view did appear", "request finished", "cache refreshed", "token expired", "retry scheduled", "connection lost"])
    text = F.concat(stamp, F.lit(" MyApp["), process, F.lit(":"), thread, F.lit("] <"), _pick(seed, 7, IOS_LEVELS), F.lit("> "), source, line, F.lit(" "), message)
    return spark.range(n).select(F.col("id").alias("line_no"), text.alias("text"))
