"""Match bitmaps: which lines a keyword matches, one bitmap for each 32,768 lines, and set algebra on them.

A keyword's bitmaps are made in one scan and written; views of filters, lanes, hits in a range and pages follow from them
without looking at texts again. Bitmaps hold line numbers from 0; those of all lines stand under the empty keyword.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.spool import release, spooled
from .search import MAX_FILTERS, contains

#: Lines of a bitmap (Spark's own size), and its bytes.
BITS = 32_768
BYTES = BITS // 8
EVERY = ""


def bitmaps_of(lines: DataFrame, keywords: list[str]) -> DataFrame:
    """(keyword, bucket, bits): one scan of ``lines`` (line_no, text) for all keywords; the empty one is every line."""
    hits = F.array_compact(F.array(*[F.lit(k) if k == EVERY else F.when(contains(k), F.lit(k)) for k in keywords]))
    rows = lines.select(F.explode(hits).alias("keyword"), "line_no")
    return rows.groupBy("keyword", F.expr(f"line_no div {BITS}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("line_no") % BITS).alias("bits"))


@dataclass
class MatchBitmaps:
    """The bitmaps of a log's lines by keyword; made for a keyword when it is first asked for."""

    lines: DataFrame
    tables: list[DataFrame] = field(default_factory=list)
    known: set[str] = field(default_factory=set)

    def add(self, keywords: list[str]) -> None:
        """Make what isn't there yet, in one scan."""
        new = [k for k in dict.fromkeys([EVERY, *(k.strip() for k in keywords)]) if k not in self.known]
        if new:
            self.tables.append(spooled(bitmaps_of(self.lines, new)))
            self.known |= set(new)

    def table(self, keywords: list[str]) -> DataFrame:
        """(keyword, bucket, bits) of some keywords and of every line."""
        if len(keywords) > MAX_FILTERS:
            raise ValueError(f"at most {MAX_FILTERS} filters")
        self.add(keywords)
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.union(t)
        own = out.where(F.col("keyword").isin([EVERY, *(k.strip() for k in keywords)]))
        return own.groupBy("keyword", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")) if len(self.tables) > 1 else own

    def extended(self, lines: DataFrame, more: DataFrame) -> MatchBitmaps:
        """The bitmaps after ``more`` lines were appended: only these are scanned, once for all keywords."""
        if not self.known:
            return MatchBitmaps(lines)
        return MatchBitmaps(lines, [*self.tables, spooled(bitmaps_of(more, sorted(self.known)))], set(self.known))

    def selected(self, keywords: list[str], choose: Callable[[dict[str, np.ndarray]], np.ndarray]) -> DataFrame:
        """(bucket, bits, n): a set made of the keywords' sets by ``choose``, which gets the words of their bitmaps (and of
        every line's, by the empty keyword). A bucket has at most 21 bitmaps."""
        names = [k.strip() for k in keywords]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.zeros(BYTES // 8, np.uint64)
            for b in batches:
                out = []
                for sets in b.column(1).to_pylist():
                    own = {k: none for k in names} | {s["keyword"]: np.frombuffer(s["bits"], np.uint64) for s in sets}
                    out.append(choose(own).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["bucket", "bits"])

        sets = self.table(keywords).groupBy("bucket").agg(F.collect_list(F.struct("keyword", "bits")).alias("sets"))
        found = sets.mapInArrow(run, "bucket bigint, bits binary").withColumn("n", F.bitmap_count("bits"))
        return found.where("n > 0")

    def lanes(self, filters: list[str], active: list[bool], others: bool) -> DataFrame:
        """(bucket, bits, n) of ``search.lanes``: lines of the active filters, with ``others`` those that none matches."""
        own = [f.strip() for f in filters]
        on = [f for f, a in zip(own, active) if a]

        def choose(sets: dict[str, np.ndarray]) -> np.ndarray:
            found = np.zeros(BYTES // 8, np.uint64)
            for f in own if others else on:
                found = found | sets[f]
            if not others:
                return found
            rest = sets[EVERY] & ~found
            for f in on:
                rest = rest | sets[f]
            return rest

        return self.selected(filters, choose)

    def all_of(self, filters: list[str]) -> DataFrame:
        """(bucket, bits, n) of the lines that all filters match; without filters every line."""
        own = [f.strip() for f in filters]

        def choose(sets: dict[str, np.ndarray]) -> np.ndarray:
            found = sets[EVERY]
            for f in own:
                found = found & sets[f]
            return found

        return self.selected(filters, choose)

    def hits(self, filters: list[str], lo: int = 0, hi: int | None = None) -> DataFrame:
        """(filter_id, hits) of each filter in the lines from ``lo`` to ``hi`` (not included); bitmaps at the edges are cut."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                counts = []
                for bucket, bits in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    ones = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
                    counts.append(int(ones[max(0, lo - bucket * BITS) : None if hi is None else max(0, hi - bucket * BITS)].sum()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["keyword", "hits"])

        rows = self.table(filters).where((F.col("keyword") != EVERY) & (F.col("bucket") >= lo // BITS))
        if hi is not None:
            rows = rows.where(F.col("bucket") <= (hi - 1) // BITS)
        sums = rows.mapInArrow(run, "keyword string, hits bigint").groupBy("keyword").agg(F.sum("hits").alias("hits"))
        names = self.lines.sparkSession.createDataFrame([(i, f.strip()) for i, f in enumerate(filters)], "filter_id int, keyword string")
        return F.broadcast(names).join(sums, "keyword", "left").select("filter_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))

    def release(self) -> None:
        for t in self.tables:
            release(t)
        self.tables, self.known = [], set()


def cut(selection: DataFrame, lo: int, hi: int) -> DataFrame:
    """The part of a set from line ``lo`` to ``hi`` (not included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for bucket, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ones = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
                ones[: max(0, lo - bucket * BITS)] = 0
                ones[max(0, hi - bucket * BITS) :] = 0
                out.append(np.packbits(ones, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["bucket", "bits"])

    near = selection.where(F.col("bucket").between(lo // BITS, max(lo, hi - 1) // BITS)).select("bucket", "bits")
    return near.mapInArrow(run, "bucket bigint, bits binary").withColumn("n", F.bitmap_count("bits")).where("n > 0")


def numbers(selection: DataFrame) -> DataFrame:
    """(line_no): the lines of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, bits in zip(b.column(0).to_pylist(), b.column(1)):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), bitorder="little"))
                yield pa.RecordBatch.from_arrays([pa.array(at + bucket * BITS, pa.int64())], ["line_no"])

    return selection.select("bucket", "bits").mapInArrow(run, "line_no bigint")


def total(selection: DataFrame) -> int:
    return selection.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def page_numbers(selection: DataFrame, offset: int = 0, limit: int = 50) -> list[int]:
    """The lines of a page of the set: the counts of the bitmaps before say which few bitmaps hold it (``limit`` at most)."""
    limit = min(limit, 2000)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each 32,768 lines
    placed = selection.select("bucket", "n").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = placed.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy("bucket").limit(limit)
    parts = F.broadcast(wanted.select("bucket", "before")).join(selection.select("bucket", "bits"), "bucket").orderBy("bucket").collect()
    out = []
    for p in parts:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(p["bits"], np.uint8), bitorder="little")) + p["bucket"] * BITS
        out += at[max(0, offset - p["before"]) : max(0, offset + limit - p["before"])].tolist()
    return out

