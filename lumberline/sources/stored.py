"""A log's lines written once, in order of their numbers, with a small table about its chunks.

Lines are dealt by chunks of 65,536 numbers and stand sorted in the files, a row group for each chunk. The table of chunks is
a sparse index (which file holds a chunk) and a zone map (the least and the greatest time of a chunk), so a range of lines or
the place of a time is found from it and from one or two chunks, whatever the log's size and however its times are ordered.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spool import release, remembered, shared_folder, spooled

CHUNK = 65_536
#: Numbers that are looked up one by one, instead of by their range.
LISTED = 2_000


def chunk_of(line_no: Column) -> Column:
    return F.floor(line_no / CHUNK).cast("long")


def carried_values(rows: DataFrame, value: str, out: str, chunk: str = "__chunk") -> DataFrame:
    """(doc_id, chunk, ``out``): the last known ``value`` before each chunk; one row for each chunk."""
    last = rows.groupBy("doc_id", chunk).agg(F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col("line_no"))).alias("__last"))
    before = Window.partitionBy("doc_id").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return last.select("doc_id", chunk, F.last("__last", True).over(before).alias(out))


def completed(lines: DataFrame, births: DataFrame, start: int | None = None) -> DataFrame:
    """``lines`` (doc_id, line_no, ts_raw_ms, ...) with ``ts_ms``, filled forward (from ``start`` on), and ``template_id`` from
    ``births`` (doc_id, line_no, template_id; 0 where there is none), dealt by chunk and in order.

    Wide rows are shuffled once: the births come into the same sorted chunks as narrow rows before their lines.
    """
    rows = lines.withColumn("__chunk", chunk_of(F.col("line_no")))
    carried = carried_values(rows.select("doc_id", "__chunk", "line_no", "ts_raw_ms"), "ts_raw_ms", "__carried")
    marks = births.select("doc_id", "line_no", F.struct("line_no", "template_id").alias("__mark"), chunk_of(F.col("line_no")).alias("__chunk"), F.lit(False).alias("__line"))
    both = rows.withColumn("__line", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    so_far = Window.partitionBy("doc_id", "__chunk").orderBy("line_no", "__line").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"__mark": F.last("__mark", True).over(so_far), "__ts": F.last("ts_raw_ms", True).over(so_far)}).where("__line")
    carried = carried.select(F.col("doc_id").alias("__d"), F.col("__chunk").alias("__c"), "__carried")
    done = seen.join(carried, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__chunk") == F.col("__c")), "left")
    template = F.when(F.col("__mark.line_no") == F.col("line_no"), F.col("__mark.template_id")).otherwise(0)
    return done.select(*lines.columns, F.coalesce("__ts", "__carried", F.lit(start).cast("long")).alias("ts_ms"), template.alias("template_id"))


@dataclass
class StoredLines:
    """The written lines. ``chunks``: doc_id, chunk, file, lines, bytes (null without ``n_bytes``), lo_ms and hi_ms (of lines
    with a time), known_ms (the least time, -1 for lines before the first one), first_line and last_line, last_ms."""

    spark: SparkSession
    paths: tuple[str, ...]
    schema: object
    _chunks: list[DataFrame] = field(default_factory=list)
    doc_id: object = None  # the only document that is meant, if there are several

    @property
    def lines(self) -> DataFrame:
        return self._own(self.spark.read.schema(self.schema).parquet(*self.paths))

    def _own(self, rows: DataFrame) -> DataFrame:
        return rows if self.doc_id is None else rows.where(F.col("doc_id") == self.doc_id)

    def document(self, doc_id) -> StoredLines:
        """The lines of one document."""
        return StoredLines(self.spark, self.paths, self.schema, [self.chunks.where(F.col("doc_id") == doc_id)], doc_id)

    @property
    def chunks(self) -> DataFrame:
        if not self._chunks:
            self._chunks.append(spooled(chunk_table(self.lines)))
        return self._chunks[0]

    def files(self, chunks: Column) -> list[str]:
        """The files that hold the chunks for which a condition holds."""
        return [r["file"] for r in self.chunks.where(chunks).select("file").distinct().collect()]

    def read(self, files: list[str]) -> DataFrame:
        return self._own(self.spark.read.schema(self.schema).parquet(*files)) if files else self.spark.createDataFrame([], self.schema)

    def range(self, lo: int, hi: int) -> DataFrame:
        """The lines from ``lo`` to ``hi`` (not included), of the files that hold their chunks; statistics of row groups and
        pages leave out the rest of a file."""
        files = self.files(F.col("chunk").between(lo // CHUNK, max(lo, hi - 1) // CHUNK)) if lo < hi else []
        return self.read(files).where((F.col("line_no") >= lo) & (F.col("line_no") < hi))

    def at(self, numbers: list[int]) -> DataFrame:
        """The lines with these numbers, 2,000 at most."""
        if len(numbers) > LISTED:
            raise ValueError(f"at most {LISTED} lines are looked up together")
        files = self.files(F.col("chunk").isin(sorted({n // CHUNK for n in numbers}))) if numbers else []
        return self.read(files).where(F.col("line_no").isin(numbers))

    def count(self) -> int:
        return self.chunks.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]

    def last_time(self) -> int | None:
        """The time that a further line without one would have."""
        return self.chunks.agg(F.max_by("last_ms", "last_line")).first()[0]

    def first_at_or_after(self, ts_ms: int) -> int | None:
        """The first line whose time isn't before ``ts_ms``: the first chunk that has one, then that chunk."""
        chunk = self.chunks.where(F.col("hi_ms") >= ts_ms).agg(F.min("chunk")).first()[0]
        return None if chunk is None else self._in(chunk).where(F.col("ts_ms") >= ts_ms).agg(F.min("line_no")).first()[0]

    def last_at_or_before(self, ts_ms: int) -> int | None:
        """The last line whose time isn't after ``ts_ms``; lines before the first time count as -1."""
        chunk = self.chunks.where(F.col("known_ms") <= ts_ms).agg(F.max("chunk")).first()[0]
        known = F.coalesce("ts_ms", F.lit(-1).cast("long"))
        return None if chunk is None else self._in(chunk).where(known <= ts_ms).agg(F.max("line_no")).first()[0]

    def first_time_at_or_after(self, line_no: int) -> int | None:
        """The time of the first timed line from ``line_no`` on."""
        rows = self._in(line_no // CHUNK).where(F.col("line_no") >= line_no)
        found = rows.where("ts_ms is not null").agg(F.min_by("ts_ms", "line_no")).first()[0]
        if found is not None:
            return found
        chunk = self.chunks.where((F.col("chunk") > line_no // CHUNK) & F.col("hi_ms").isNotNull()).agg(F.min("chunk")).first()[0]
        return None if chunk is None else self._in(chunk).where("ts_ms is not null").agg(F.min_by("ts_ms", "line_no")).first()[0]

    def _in(self, chunk: int) -> DataFrame:
        return self.range(chunk * CHUNK, (chunk + 1) * CHUNK).select("line_no", "ts_ms")

    def with_more(self, more: StoredLines) -> StoredLines:
        """These lines and later ones; neither is written again."""
        return StoredLines(self.spark, (*self.paths, *more.paths), self.schema, [spooled(self.chunks.unionByName(more.chunks))], self.doc_id)

    def release(self) -> None:
        for table in (self.lines, *self._chunks):
            release(table)


def chunk_table(lines: DataFrame) -> DataFrame:
    size = F.sum("n_bytes") if "n_bytes" in lines.columns else F.lit(None).cast("long")
    numbered = lines.withColumn("file", F.col("_metadata.file_path")).withColumn("chunk", chunk_of(F.col("line_no")))
    return numbered.groupBy("doc_id", "chunk", "file").agg(
        F.count(F.lit(1)).alias("lines"),
        size.alias("bytes"),
        F.min("ts_ms").alias("lo_ms"),
        F.max("ts_ms").alias("hi_ms"),
        F.min(F.coalesce("ts_ms", F.lit(-1).cast("long"))).alias("known_ms"),
        F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"),
        F.max_by("ts_ms", "line_no").alias("last_ms"),
    )


def store(lines: DataFrame) -> StoredLines:
    """Write ``lines`` (doc_id, line_no, ts_ms, ...) that stand in order by chunk, as ``completed`` gives them."""
    spark = lines.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    remembered(spark, path)
    lines.write.option("parquet.block.row.count.limit", CHUNK).parquet(path)
    return StoredLines(spark, (path,), lines.schema)


def stored(lines: DataFrame) -> StoredLines:
    """``store`` of lines in any order."""
    dealt = lines.withColumn("__chunk", chunk_of(F.col("line_no"))).repartition("doc_id", "__chunk").sortWithinPartitions("doc_id", "line_no")
    return store(dealt.drop("__chunk"))
