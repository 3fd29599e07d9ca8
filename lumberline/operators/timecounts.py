"""Counts of lines up to any time, written once, so that a timeline reads the edges of its buckets only.

The distinct times of a log (or its line numbers, where it has no times) stand sorted in files, each with the number of lines
up to it, in cells of equal width; a small table has the number of lines before each cell. What lies below an edge is the
number before its cell, or, where the edge cuts a cell, that up to the last time below the edge. Buckets are differences, so
they are exact at every scale. Lanes (lines that a filter matches) have counts of their own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.spool import release, remembered, shared_folder, spooled
from .analysis import DEFAULT_BUCKETS, LEAST_BUCKETS, MOST_BUCKETS, domain

#: Cells of a domain (at most so many), and the lane of all lines.
CELLS, ALL = 16_384, -1


def counted(lines: DataFrame, matched: DataFrame | None, by_time: bool) -> DataFrame:
    """(lane, x, n): lines by lane and place; ``matched`` has filter_id, line_no, ts_ms."""
    x = F.col("ts_ms" if by_time else "line_no")
    rows = lines.select(F.lit(ALL).alias("lane"), x.alias("x"))
    if matched is not None:
        rows = rows.union(matched.select(F.col("filter_id").cast("int"), x))
    return rows.where("x is not null").groupBy("lane", "x").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class TimeCounts:
    """``times``: lane, cell, x, n, upto (lines of the lane up to x); ``cells``: lane, cell, below (lines before the cell), of
    all cells and the end; ``files``: (path, first cell, last cell) of the files of ``times``."""

    spark: SparkSession
    by_time: bool
    lo: int
    hi: int
    width: int
    times: DataFrame
    cells: DataFrame
    files: list[tuple[str, int, int]]

    @classmethod
    def of(cls, lines: DataFrame, matched: DataFrame | None = None) -> TimeCounts:
        """The counts of a log and its lanes. A log without lines has none: ``ValueError``."""
        d = domain(lines).first()
        if d["lo"] is None:
            raise ValueError("the log is empty")
        return cls._written(lines.sparkSession, counted(lines, matched, d["by_time"]), d["by_time"], d["lo"], d["hi"])

    @classmethod
    def _written(cls, spark: SparkSession, counts: DataFrame, by_time: bool, lo: int, hi: int) -> TimeCounts:
        width = -(-(hi - lo + 1) // CELLS)
        last = (hi - lo) // width
        cell = F.expr(f"(x - {lo}) div {width}")
        rows = spooled(counts.withColumn("cell", cell))
        sums = rows.groupBy("lane", "cell").agg(F.sum("n").alias("n"))
        every = rows.select("lane").distinct().crossJoin(F.broadcast(spark.range(last + 2).select(F.col("id").alias("cell"))))  # lanes are few: 20 filters at most
        before = Window.partitionBy("lane").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = spooled(every.join(sums, ["lane", "cell"], "left").select("lane", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below")))
        inside = Window.partitionBy("lane", "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        upto = rows.withColumn("__in", F.sum("n").over(inside)).join(cells, ["lane", "cell"])
        path = f"{shared_folder(spark).rstrip('/')}/times-{uuid.uuid4().hex}"
        remembered(spark, path)
        upto.select("lane", "cell", "x", "n", (F.col("__in") + F.col("below")).alias("upto")).repartitionByRange("cell").sortWithinPartitions("cell", "lane", "x").write.parquet(path)
        release(rows)
        times = spark.read.parquet(path)
        files = times.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("cell").alias("a"), F.max("cell").alias("b")).collect()  # a row for each file
        return cls(spark, by_time, lo, hi, width, times, cells, [tuple(f) for f in files])

    def extended(self, more: DataFrame, matched: DataFrame | None = None) -> TimeCounts:
        """The counts with further lines (and their matches): only these are read, and the distinct times known so far. The
        domain grows with them. A log that had no times and gets some has to be counted anew: ``ValueError``."""
        d = more.agg(F.min("ts_ms"), F.max("ts_ms"), F.min("line_no"), F.max("line_no")).first()
        lo, hi = (d[0], d[1]) if self.by_time else (d[2], d[3])
        if not self.by_time and d[0] is not None:
            raise ValueError("the log has times now; it has to be counted anew")
        if lo is None:
            return self
        both = self.times.select("lane", "x", "n").union(counted(more, matched, self.by_time)).groupBy("lane", "x").agg(F.sum("n").alias("n"))
        return TimeCounts._written(self.spark, both, self.by_time, min(lo, self.lo), max(hi, self.hi))

    def details(self, cut: list[int]) -> DataFrame:
        """The rows of ``times`` of some cells: the files that hold one of them are read."""
        paths = [f for f, a, b in self.files if any(a <= c <= b for c in cut)]
        if not paths:
            return self.times.limit(0)
        return self.spark.read.schema(self.times.schema).parquet(*paths).where(F.col("cell").between(min(cut), max(cut)))

    def below(self, edges: list[int]) -> DataFrame:
        """(lane, at, below): of each lane the lines below each edge (by its place in the list)."""
        inside = [min(max(e, self.lo), self.hi + 1) for e in edges]
        placed = [(i, e, (e - self.lo) // self.width if e <= self.hi else (self.hi - self.lo) // self.width + 1, e <= self.hi and (e - self.lo) % self.width > 0) for i, e in enumerate(inside)]
        table = self.spark.createDataFrame(placed, "at int, edge bigint, cell bigint, cut boolean")
        whole = self.cells.join(F.broadcast(table), "cell")
        cut = sorted({p[2] for p in placed if p[3]})
        if not cut:
            return whole.select("lane", "at", "below")
        asked = F.broadcast(table.where("cut").select(F.col("cell").alias("__cell"), "at", "edge"))
        found = self.details(cut).join(asked, (F.col("cell") == F.col("__cell")) & (F.col("x") < F.col("edge"))).groupBy("lane", "at").agg(F.max("upto").alias("upto"))
        return whole.join(found, ["lane", "at"], "left").select("lane", "at", F.greatest("below", F.coalesce("upto", F.lit(0))).alias("below"))

    def _differences(self, edges: list[int], out: str) -> DataFrame:
        w = Window.partitionBy("lane").orderBy("at")
        rows = self.below(edges).select("lane", F.col("at").alias(out), (F.lead("below").over(w) - F.col("below")).alias("cnt"))
        return rows.where("cnt is not null")

    def histograms(self, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
        """(lane, bucket, cnt) of all lanes, zeros included."""
        buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, buckets))
        span = max(self.hi - self.lo, 1)
        edges = [self.lo + -(-b * span // (buckets - 1)) for b in range(buckets)] + [self.hi + 1]
        return self._differences(edges, "bucket")

    def histogram(self, buckets: int = DEFAULT_BUCKETS, lane: int = ALL) -> DataFrame:
        """(bucket, x, cnt) as ``analysis.histogram`` gives it."""
        buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, buckets))
        found = self.histograms(buckets).where(F.col("lane") == lane)
        return found.select(F.col("bucket").cast("long").alias("bucket"), F.expr(f"{self.lo} + ({max(self.hi - self.lo, 1)} * cast(bucket as bigint)) div {buckets - 1}").alias("x"), "cnt")

    def zoomed(self, start: int, end: int, columns: int, lane: int = ALL) -> DataFrame:
        """(col, cnt): the lines from ``start`` to ``end``, both included, in columns of equal width."""
        edges = [start + -(-c * (end - start + 1) // columns) for c in range(columns + 1)]
        return self._differences(edges, "col").where(F.col("lane") == lane).select("col", "cnt")

    def release(self) -> None:
        release(self.times)
        release(self.cells)
