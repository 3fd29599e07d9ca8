"""Keyword scans, filtered views, lanes, ranges and pages over numbered lines (line_no, ts_ms, text, template_id).

All are predicates and narrow projections; ranges come from one aggregate. Lines are numbered from 0; payloads from 1.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import format_ms_column, parse_time_param
from ..sources.stored import StoredLines

MAX_FILTERS = 20


def contains(keyword: str, text: Column | None = None) -> Column:
    """Case-sensitive substring test; an empty keyword matches nothing."""
    keyword = keyword.strip()
    return (text if text is not None else F.col("text")).contains(keyword) if keyword else F.lit(False)


def contains_folded(needle: str, text: Column | None = None) -> Column:
    """Substring test that ignores the case of A-Z."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    needle = needle.strip().translate(str.maketrans(upper, lower))
    return F.translate(text if text is not None else F.col("text"), upper, lower).contains(needle) if needle else F.lit(False)


def any_of(filters: list[str]) -> Column:
    return reduce(or_, [contains(f) for f in filters], F.lit(False))


def matches(lines: DataFrame, filters: list[str]) -> DataFrame:
    """(filter_id, line_no, ts_ms): one row for each filter that a line contains; a line is scanned once."""
    hits = F.array_compact(F.array(*[F.when(contains(f), F.lit(i)) for i, f in enumerate(filters)]))
    return lines.select(F.explode(hits).alias("filter_id"), "line_no", "ts_ms")


def filtered(lines: DataFrame, filters: list[str]) -> DataFrame:
    """Lines that contain any filter; without filters all."""
    return lines.where(any_of(filters)) if filters else lines


def everything_else(lines: DataFrame, filters: list[str]) -> DataFrame:
    return lines.where(~any_of(filters))


def lanes(lines: DataFrame, filters: list[str], active: list[bool], others: bool) -> DataFrame:
    """Lines of the active filters, and with ``others`` those that no filter matches; all if everything is on."""
    if others and all(active):
        return lines
    on = any_of([f for f, a in zip(filters, active) if a])
    return lines.where(on | (~any_of(filters) if others else F.lit(False)))


def find(lines: DataFrame, needle: str, fold_case: bool = False) -> DataFrame:
    return lines.where(contains_folded(needle) if fold_case else contains(needle))


def in_window(after: int | None = None, before: int | None = None) -> Column:
    """Closed time window on forward-filled times; lines before the first time count as -1."""
    ts = F.coalesce(F.col("ts_ms"), F.lit(-1).cast("long"))
    test = F.lit(True)
    if after is not None:
        test = test & (ts >= after)
    if before is not None:
        test = test & (ts <= before)
    return test


def hit_summary(lines: DataFrame, keyword: str, after: int | None = None, before: int | None = None) -> DataFrame:
    """(total, first_seen_ms, last_seen_ms) of a keyword's hits in a window."""
    hits = lines.where(contains(keyword) & in_window(after, before))
    return hits.agg(F.count(F.lit(1)).alias("total"), F.min("ts_ms").alias("first_seen_ms"), F.max("ts_ms").alias("last_seen_ms"))


def truncated(text: Column, limit: int = 1000) -> Column:
    """At most ``limit`` bytes, cut at a character and marked."""
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, limit).cast("string")), "�+$", "")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(head, F.lit("…")))


def display_text(text: Column, limit: int = 2000) -> Column:
    """What a long line is shown as: its first ``limit`` bytes, cut at a character, and its size."""
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, limit).cast("string")), "�+$", "")
    note = F.concat(F.lit("  …["), F.octet_length(text).cast("string"), F.lit(" bytes total, truncated]"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(head, note))


def payload(lines: DataFrame) -> DataFrame:
    """(line, time, template_id, text) as shown to a user: numbered from 1, at most 1,000 bytes of text."""
    return lines.select((F.col("line_no") + 1).alias("line"), format_ms_column(F.col("ts_ms")).alias("time"), "template_id", truncated(F.col("text")).alias("text"))


def page(lines: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page in line order; top-k in each task, so no global sort."""
    return lines.orderBy("line_no").offset(offset).limit(min(limit, 2000))


@dataclass(frozen=True)
class Range:
    """Half-open range of lines."""

    lo: int
    hi: int

    def lines(self, lines: DataFrame) -> DataFrame:
        return lines.where((F.col("line_no") >= self.lo) & (F.col("line_no") < self.hi))


def resolve_range(lines: DataFrame, start: int | str | None = None, end: int | str | None = None) -> Range:
    """Bounds are 1-based lines (clamped) or times; a start time is the first line at or after it, an end time the last
    line at or before it, both clamped to existing lines. All come from one aggregate."""
    t0, t1 = _time_of(start), _time_of(end)
    known = F.coalesce(F.col("ts_ms"), F.lit(-1).cast("long"))
    n, lo, hi = lines.agg(
        F.count(F.lit(1)),
        F.min(F.when(F.col("ts_ms") >= t0, F.col("line_no"))) if t0 is not None else F.lit(None),
        F.max(F.when(known <= t1, F.col("line_no"))) if t1 is not None else F.lit(None),
    ).first()
    return _range_of(start, end, n, lo, hi)


def resolve_stored(log: StoredLines, start: int | str | None = None, end: int | str | None = None) -> Range:
    """``resolve_range`` of a whole stored log: from its table of chunks, and one chunk for each time."""
    t0, t1 = _time_of(start), _time_of(end)
    return _range_of(start, end, log.count(), None if t0 is None else log.first_at_or_after(t0), None if t1 is None else log.last_at_or_before(t1))


def _time_of(bound: int | str | None) -> int | None:
    if not isinstance(bound, str):
        return None
    if (ms := parse_time_param(bound)) is None:
        raise ValueError(f"can't read the time {bound!r}")
    return ms


def _range_of(start: int | str | None, end: int | str | None, n: int, lo: int | None, hi: int | None) -> Range:
    if not n:
        raise ValueError("the log is empty")
    for bound in (start, end):
        if isinstance(bound, int) and bound < 1:
            raise ValueError("lines are numbered from 1")
    first = 0 if start is None else min(start, n) - 1 if isinstance(start, int) else (n - 1 if lo is None else lo)
    last = n - 1 if end is None else min(end, n) - 1 if isinstance(end, int) else (0 if hi is None else hi)
    if first > last:
        raise ValueError("the range is empty")
    return Range(first, last + 1)


def trimmed(lines: DataFrame, lo: int, hi: int) -> DataFrame:
    """The lines of a window, numbered from 0 again."""
    return lines.where((F.col("line_no") >= lo) & (F.col("line_no") < hi)).withColumn("line_no", F.col("line_no") - lo)


class FilterSet:
    """Up to 20 distinct keywords; blanks are refused."""

    def __init__(self, keywords: list[str] | None = None):
        self.keywords: list[str] = []
        for k in keywords or []:
            self.add(k)

    def add(self, keyword: str) -> bool:
        keyword = keyword.strip()
        if not keyword:
            raise ValueError("a filter can't be blank")
        if keyword in self.keywords:
            return False
        if len(self.keywords) >= MAX_FILTERS:
            raise ValueError(f"at most {MAX_FILTERS} filters")
        self.keywords.append(keyword)
        return True

    def remove(self, position: int) -> str:
        return self.keywords.pop(position)

    def clear(self) -> None:
        self.keywords.clear()


class LaneState:
    """Which filters' lanes are shown. Nothing shown at all turns the remaining lines on again."""

    def __init__(self, filters: FilterSet):
        self.filters, self.active, self.others = filters, [True] * len(filters.keywords), True

    def toggle(self, position: int | None) -> None:
        """One lane, or the remaining lines (None)."""
        if position is None:
            self.others = not self.others
        else:
            self.active[position] = not self.active[position]

    def toggle_all(self) -> None:
        on = not (self.others and all(self.active))
        self.others, self.active = on, [on] * len(self.active)

    def remove(self, position: int) -> None:
        self.filters.remove(position)
        del self.active[position]
        if not any(self.active):
            self.others = True

    def clear(self) -> None:
        self.filters.clear()
        self.active, self.others = [], True

    def view(self, lines: DataFrame) -> DataFrame:
        return lanes(lines, self.filters.keywords, self.active, self.others)
