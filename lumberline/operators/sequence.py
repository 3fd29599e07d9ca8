"""Runs, context, navigation, nearest lines and pins: operators on the order of lines.

Neighbours come from ``with_previous`` (chunked, one row a chunk crosses edges), so that a long file is many tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefmt import format_ms
from .analysis import CHUNK, with_previous

#: Runs of so many lines or more are shown as one entry.
COLLAPSE = 3


def numbered_groups(lines: DataFrame, starts: Column, out: str) -> DataFrame:
    """``lines`` with a running count of the lines for which ``starts`` holds, in line order, by chunks."""
    rows = lines.withColumn("__chunk", F.floor(F.col("line_no") / CHUNK).cast("long")).withColumn("__s", starts.cast("long"))
    sums = rows.groupBy("__chunk").agg(F.sum("__s").alias("__n"))
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__run", F.sum("__s").over(inside)).join(carried, "__chunk").withColumn(out, F.col("__base") + F.col("__run")).drop("__chunk", "__s", "__run", "__base")


def runs(lines: DataFrame, key: str = "template_id") -> DataFrame:
    """(run_id, start_line, end_line, cnt, <key>, start_ms, end_ms): maximal runs of equal neighbours in the view."""
    seen = with_previous(lines.select("line_no", "ts_ms", key), [key])
    grouped = numbered_groups(seen, ~F.col(key).eqNullSafe(F.col(f"prev_{key}")) | ~F.col("has_prev"), "run_id")
    return grouped.groupBy("run_id", key).agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count(F.lit(1)).alias("cnt"), F.min_by("ts_ms", "line_no").alias("start_ms"), F.max_by("ts_ms", "line_no").alias("end_ms")
    ).select("run_id", "start_line", "end_line", "cnt", key, "start_ms", "end_ms")


def sequence(lines: DataFrame, max_entries: int = 2000) -> DataFrame:
    """(line, ts_ms, template_id) in line order, numbered from 1."""
    return lines.select((F.col("line_no") + 1).alias("line"), "ts_ms", "template_id").orderBy("line").limit(min(max_entries, 2000))


def collapsed_sequence(lines: DataFrame, max_entries: int = 2000) -> DataFrame:
    """(line, end_line, ts_ms, template_id, cnt): runs of three lines or more as one entry, other lines each."""
    r = runs(lines).where(F.col("cnt") >= COLLAPSE).select("start_line", "end_line", "cnt", "template_id", "start_ms")
    long_runs = r.select((F.col("start_line") + 1).alias("line"), (F.col("end_line") + 1).alias("end_line"), F.col("start_ms").alias("ts_ms"), "template_id", "cnt")
    seen = with_previous(lines.select("line_no", "ts_ms", "template_id"), ["template_id"])
    grouped = numbered_groups(seen, ~F.col("template_id").eqNullSafe(F.col("prev_template_id")) | ~F.col("has_prev"), "run_id")
    short = runs(lines).where(F.col("cnt") < COLLAPSE).select("run_id")
    single = grouped.join(short, "run_id", "left_semi").select((F.col("line_no") + 1).alias("line"), (F.col("line_no") + 1).alias("end_line"), "ts_ms", "template_id", F.lit(1).cast("long").alias("cnt"))
    return long_runs.union(single).orderBy("line").limit(min(max_entries, 2000))


def context(lines: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """(hit, line_no, ts_ms, template_id): the lines within ``n`` (up to 20) of each hit that the view has.

    An equi-join on line numbers: each hit asks for 2n + 1 of them.
    """
    n = max(0, min(20, n))
    wanted = hits.select(F.col("line_no").alias("hit"), F.explode(F.sequence(F.col("line_no") - n, F.col("line_no") + n)).alias("line_no"))
    return wanted.join(lines.select("line_no", "ts_ms", "template_id"), "line_no").select("hit", "line_no", "ts_ms", "template_id")


def context_runs(lines: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """(hit, start_line, end_line, cnt, template_id): each hit's context in runs. A hit's rows are 41 at most."""
    around = context(lines, hits, n)
    w = Window.partitionBy("hit").orderBy("line_no")
    marked = around.withColumn("__new", (~F.col("template_id").eqNullSafe(F.lag("template_id").over(w)) | F.lag("line_no").over(w).isNull()).cast("int")).withColumn("__run", F.sum("__new").over(w))
    return marked.groupBy("hit", "__run", "template_id").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count(F.lit(1)).alias("cnt")).select("hit", "start_line", "end_line", "cnt", "template_id")


def _placed(matched: DataFrame) -> DataFrame:
    """``matched`` with ``k`` and ``n`` (place among its filter's matches, and their number) and ``prev`` and ``next``
    (line_no, ts_ms). A filter's matches are counted by chunks, one row of which each crosses the edges."""
    here = F.struct("line_no", "ts_ms")
    rows = matched.select("filter_id", "line_no", "ts_ms", F.floor(F.col("line_no") / CHUNK).cast("long").alias("__chunk"))
    parts = rows.groupBy("filter_id", "__chunk").agg(F.count(F.lit(1)).alias("__n"), F.min(here).alias("__first"), F.max(here).alias("__last"))
    order = Window.partitionBy("filter_id").orderBy("__chunk")
    edges = parts.select(
        F.col("filter_id").alias("__f"),
        F.col("__chunk").alias("__c"),
        F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"),
        F.sum("__n").over(Window.partitionBy("filter_id")).alias("n"),
        F.lag("__last").over(order).alias("__before"),
        F.lead("__first").over(order).alias("__after"),
    )
    inside = Window.partitionBy("filter_id", "__chunk").orderBy("line_no")
    numbered = rows.withColumns({"__k": F.row_number().over(inside), "__prev": F.lag(here).over(inside), "__next": F.lead(here).over(inside)})
    joined = numbered.join(edges, (F.col("filter_id") == F.col("__f")) & (F.col("__chunk") == F.col("__c")))
    return joined.select("filter_id", "line_no", "ts_ms", (F.col("__base") + F.col("__k")).cast("long").alias("k"), "n", F.coalesce("__prev", "__before").alias("prev"), F.coalesce("__next", "__after").alias("next"))


def occurrences(matched: DataFrame) -> DataFrame:
    """(filter_id, line_no, k, n, prev_delta_ms, next_delta_ms): the place of each match among its filter's matches and
    the time to its neighbours."""
    return _placed(matched).select("filter_id", "line_no", "k", "n", (F.col("ts_ms") - F.col("prev.ts_ms")).alias("prev_delta_ms"), (F.col("next.ts_ms") - F.col("ts_ms")).alias("next_delta_ms"))


def step(lines: DataFrame, line_no: int, forward: bool = True, wrap: bool = True) -> DataFrame:
    """(line_no): the next (or previous) line of a view after a line; wraps around, or stays at the edge."""
    c = F.col("line_no")
    if forward:
        found = F.min(F.when(c > line_no, c))
        edge = F.min(c) if wrap else F.max(c)
    else:
        found = F.max(F.when(c < line_no, c))
        edge = F.max(c) if wrap else F.min(c)
    return lines.agg(F.coalesce(found, edge).alias("line_no"))


def nearest(lines: DataFrame, line_no: int) -> DataFrame:
    """The line of the view nearest to a number; the smaller of two equally near."""
    return lines.orderBy(F.abs(F.col("line_no") - line_no), "line_no").limit(1)


def nearest_in_time(lines: DataFrame, ts_ms: int) -> DataFrame:
    """The line of the view nearest to a time; the earlier of two equally near."""
    return lines.where("ts_ms is not null").orderBy(F.abs(F.col("ts_ms") - ts_ms), "ts_ms", "line_no").limit(1)


def nearest_each(probes: DataFrame, lines: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """(probe_id, ts_ms, line_no): for each probe (probe_id, probe_ms) the line nearest in time; the earlier of two equally
    near, and the first line of that time. Probes without a time, or beside no line with one, are left out; an id that occurs
    again is one probe of several times.

    Lines of one millisecond are one row. Probes and lines are put in order together, inside buckets of time (so a task
    sorts no more milliseconds than a bucket has, and its probes); what lies before and after a bucket comes from a table
    with one row for each.
    """
    first = lines.where("ts_ms is not null").groupBy("ts_ms").agg(F.min("line_no").alias("line_no")).select(F.struct("ts_ms", "line_no").alias("at"))
    bucket = lambda ms: F.floor(ms / bucket_ms)
    rows = first.select(F.lit(None).alias("probe_id"), F.col("at.ts_ms").alias("ms"), "at").unionByName(
        probes.where("probe_ms is not null").select("probe_id", F.col("probe_ms").alias("ms")), allowMissingColumns=True
    ).withColumn("b", bucket(F.col("ms")))
    edges = rows.groupBy("b").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    # frames only grow, in both orders: one that shrinks is gone through anew for each row
    upto, sofar = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
    before, after = Window.orderBy("b").rowsBetween(*upto), Window.orderBy(F.desc("b")).rowsBetween(*upto)
    edges = edges.select("b", F.last("hi", True).over(before).alias("p"), F.last("lo", True).over(after).alias("q"))
    lines_first = F.col("at").isNull()  # a line comes before a probe of its time
    up, down = (Window.partitionBy("b").orderBy(ms, lines_first).rowsBetween(*sofar) for ms in (F.asc("ms"), F.desc("ms")))
    seen = rows.withColumn("prev", F.last("at", True).over(up)).withColumn("next", F.last("at", True).over(down))
    asked = seen.where("at is null").join(edges, "b").select("probe_id", "ms", F.coalesce("prev", "p").alias("prev"), F.coalesce("next", "q").alias("next"))
    nearer = F.col("next").isNotNull() & (F.col("prev").isNull() | (F.col("next.ts_ms") - F.col("ms") < F.col("ms") - F.col("prev.ts_ms")))
    found = asked.select("probe_id", "ms", F.when(nearer, F.col("next")).otherwise(F.col("prev")).alias("at")).where("at is not null")
    nearest = F.min(F.struct(F.abs(F.col("at.ts_ms") - F.col("ms")).alias("far"), "at.ts_ms", "at.line_no")).alias("at")
    return found.groupBy("probe_id").agg(nearest).select("probe_id", "at.ts_ms", "at.line_no")


def approximate_line(lines: DataFrame, ts_ms: int) -> DataFrame:
    """(line_no): the first line at or after a time, else the last timed line before it."""
    c = F.col("line_no")
    return lines.agg(F.coalesce(F.min(F.when(F.col("ts_ms") >= ts_ms, c)), F.max(F.when(F.col("ts_ms") < ts_ms, c))).alias("line_no"))


def pins(lines: DataFrame, pinned: DataFrame) -> DataFrame:
    """``pinned`` (pin_id, line_numbers array<long>, comment) with times, in display order (``place`` from 1), and the
    time since the pin before: timed pins by time, then untimed ones by line. Pins are made by hand, so they are few."""
    ends = pinned.select("pin_id", F.explode("line_numbers").alias("line_no")).join(lines.select("line_no", "ts_ms"), "line_no")
    ends = ends.groupBy("pin_id").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.min("line_no").alias("start_line"))
    order = Window.orderBy(F.col("start_ms").asc_nulls_last(), "start_line", "pin_id")
    return pinned.join(ends, "pin_id", "left").select(
        "pin_id", "start_line", "start_ms", "end_ms", "comment", F.row_number().over(order).cast("long").alias("place"), (F.col("start_ms") - F.lag("end_ms").over(order)).alias("since_prev_ms")
    )


def pin_text(lines: DataFrame, pinned: DataFrame) -> DataFrame:
    """(pin_id, card): each pin's comment and lines as text."""
    body = pinned.select("pin_id", "comment", F.explode("line_numbers").alias("line_no")).join(lines.select("line_no", "text"), "line_no")
    body = body.groupBy("pin_id", "comment").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("rows"))
    return body.select("pin_id", F.concat_ws("\n", F.when(F.col("comment") != "", F.col("comment")), F.concat_ws("\n", F.transform("rows", lambda r: r["text"]))).alias("card"))


def tenths(x: Column) -> Column:
    """A number that isn't negative with one decimal, rounded by its exact binary value, halves to even.

    Ten times the number is split into a rounded product and its exact error, so the digit after the first is seen whole.
    """
    product = x * 10
    high = x * 134_217_729.0  # splits the number in halves whose products are exact
    high = high - (high - x)
    error = (high * 10 - product) + (x - high) * 10
    whole = F.floor(product)
    beyond = (product - whole - 0.5) + error
    up = (beyond > 0) | ((beyond == 0) & (whole % 2 == 1))
    n = whole + up.cast("bigint")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def _parts(ms: Column, unit: int, small: int) -> tuple[Column, Column]:
    return F.floor(ms / unit).cast("string"), F.floor(ms % unit / small).cast("string")


def format_delta_ms(ms: Column) -> Column:
    """The time between two lines: hours and minutes, minutes and seconds, seconds, or milliseconds."""
    h, m = _parts(ms, 3_600_000, 60_000)
    minutes, s = _parts(ms, 60_000, 1_000)
    text = F.when(ms >= 3_600_000, F.concat(h, F.lit("h "), m, F.lit("m"))).when(ms >= 60_000, F.concat(minutes, F.lit("m "), s, F.lit("s")))
    return F.concat(F.lit("Δ "), text.when(ms >= 1_000, F.concat(tenths(ms / 1000.0), F.lit("s"))).otherwise(F.concat(ms.cast("string"), F.lit("ms"))))


def format_human_ms(ms: Column) -> Column:
    """The same in words of a sentence; a second unit of zero is left out, and less than nothing is nothing."""
    ms = F.greatest(ms, F.lit(0))
    h, m = _parts(ms, 3_600_000, 60_000)
    minutes, s = _parts(ms, 60_000, 1_000)
    hours = F.when(m == "0", F.concat(h, F.lit("h"))).otherwise(F.concat(h, F.lit("h "), m, F.lit("m")))
    short = F.when(s == "0", F.concat(minutes, F.lit("m"))).otherwise(F.concat(minutes, F.lit("m "), s, F.lit("sec")))
    return F.when(ms >= 3_600_000, hours).when(ms >= 60_000, short).when(ms >= 1_000, F.concat(tenths(ms / 1000.0), F.lit("sec"))).otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def format_pin_ms(ms: Column) -> Column:
    """The time between pins in its largest unit, up to days; from a second on without a sign."""
    seconds = F.abs(ms) / 1000.0
    minutes = seconds / 60.0
    hours = minutes / 60.0
    out = F.when(F.abs(ms) < 1_000, F.concat(ms.cast("string"), F.lit(" ms"))).when(seconds < 60, F.concat(tenths(seconds), F.lit(" sec")))
    return out.when(minutes < 60, F.concat(tenths(minutes), F.lit(" min"))).when(hours < 24, F.concat(tenths(hours), F.lit(" hr"))).otherwise(F.concat(tenths(hours / 24.0), F.lit(" days")))


def occurrence_text(matched: DataFrame, by_time: bool = True) -> DataFrame:
    """(filter_id, line_no, label): the place of each match among its filter's matches and the way to its neighbours, in time
    (in lines where a time is missing, or for a log without times)."""

    def way(lines: Column, ms: Column) -> Column:
        in_lines = F.concat(lines.cast("string"), F.lit(" lines"))
        return F.when(ms.isNotNull(), format_human_ms(ms)).otherwise(in_lines) if by_time else in_lines

    before = way(F.col("line_no") - F.col("prev.line_no"), F.col("ts_ms") - F.col("prev.ts_ms"))
    after = way(F.col("next.line_no") - F.col("line_no"), F.col("next.ts_ms") - F.col("ts_ms"))
    label = F.concat(
        F.lit("Occurrence "),
        F.col("k").cast("string"),
        F.lit(" / "),
        F.col("n").cast("string"),
        F.when(F.col("prev").isNotNull(), F.concat(F.lit(" | prev "), before, F.lit(" ago"))).otherwise(""),
        F.when(F.col("next").isNotNull(), F.concat(F.lit(" | next "), after, F.lit(" after"))).otherwise(""),
    )
    return _placed(matched).select("filter_id", "line_no", label.alias("label"))


def axis_labels(start: int, end: int, by_time: bool = True, ticks: int = 7) -> list[tuple[int, str]]:
    """(value, label) of the marks of a timeline's axis; times leave out the date or the hour that all marks share."""
    values = [start + int(i / (ticks - 1) * (end - start)) for i in range(ticks)]
    if not by_time:
        return [(v, f"L{v}") for v in values]
    texts = [format_ms(v) for v in values]
    if texts[0][:13] == texts[-1][:13]:
        cut = 14
    else:
        cut = 11 if texts[0][:10] == texts[-1][:10] else 0
    return [(v, t[cut:]) for v, t in zip(values, texts)]


def effective_zoom(zoom: tuple[int, int] | None, start: int, end: int) -> tuple[int, int]:
    """What is shown of a domain: a zoomed range inside it, or all."""
    return (max(zoom[0], start), min(zoom[1], end)) if zoom else (start, end)


def place_of_line(by_time: bool = True) -> Column:
    """Where a line stands on the timeline: its time, or its number from 1."""
    return F.col("ts_ms") if by_time else F.col("line_no") + 1


def caption(value: int, by_time: bool = True) -> str:
    return format_ms(value) if by_time else f"~line {value}"


# Fixed value: what ends a word under the pointer, besides white space.
DELIMITERS = r"""\s\p{IsWhite_Space}\-\[\]{}(),"'"""


def keyword_at(text: Column, position: int | Column) -> Column:
    """The word around a 0-based character position; null on a delimiter and outside the line."""
    at = F.lit(position) if isinstance(position, int) else position
    head = F.regexp_extract(F.substring(text, F.lit(1), at), f"[^{DELIMITERS}]*$", 0)
    tail = F.regexp_extract(F.substring(text, at + 1, F.length(text)), f"^[^{DELIMITERS}]+", 0)
    return F.when((at >= 0) & (tail != ""), F.concat(head, tail))


def highlight_spans(text: Column, search: str = "", keyword: str = "", filters: list[str] | None = None) -> Column:
    """array<struct<start, stop, kind>> of matches: search before keyword before filters. What a span shares with one
    before it is left to that one, and its other parts stay."""
    spans = F.array().cast("array<struct<start:int,stop:int,kind:string>>")
    for kind, words in (("search", [search]), ("keyword", [keyword]), ("filter", filters or [])):
        for word in words:
            if word.strip():
                spans = F.array_sort(F.concat(spans, _uncovered(_matches(text, word.strip(), kind == "keyword"), spans, kind)))
    return spans


def _matches(text: Column, word: str, any_case: bool) -> Column:
    """array<struct<a, b>>: where the word stands."""
    parts = F.split(text, ("(?i)" if any_case else "") + re.escape(word), -1)
    places = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def found(_: Column, i: Column) -> Column:
        before = F.slice(parts, F.lit(1), i + 1)
        at = F.aggregate(before, F.lit(0), lambda a, x: a + F.length(x)) + i * len(word)
        return F.struct(at.cast("int").alias("a"), (at + len(word)).cast("int").alias("b"))

    return F.transform(places, found)


def _uncovered(matches: Column, spans: Column, kind: str) -> Column:
    """The parts of the matches that none of the sorted ``spans`` covers."""

    def parts(m: Column) -> Column:
        over = F.filter(spans, lambda s: (s["start"] < m["b"]) & (m["a"] < s["stop"]))
        starts = F.concat(F.array(m["a"]), F.transform(over, lambda s: s["stop"]))
        stops = F.concat(F.transform(over, lambda s: s["start"]), F.array(m["b"]))
        pieces = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop"), F.lit(kind).alias("kind")))
        return F.filter(pieces, lambda p: p["start"] < p["stop"])

    return F.flatten(F.transform(matches, parts))
