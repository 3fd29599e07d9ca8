"""Timelines, gaps, densest minutes, summaries, template anomalies and samples.

Aggregates with partial sums throughout; results are a few rows or one row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS, LEAST_BUCKETS, MOST_BUCKETS = 2048, 16, 8192
ERROR_WORDS = ("error", "fatal", "exception", "panic")
#: Lines of a chunk of a file: neighbours are looked up inside chunks, and across their edges.
CHUNK = 65_536


def domain(lines: DataFrame) -> DataFrame:
    """One row (by_time, lo, hi): the time range, or the numbers of the lines where there is none."""
    a = lines.agg(F.min("ts_ms").alias("ta"), F.max("ts_ms").alias("tb"), F.min("line_no").alias("la"), F.max("line_no").alias("lb"))
    timed = F.coalesce(F.col("tb") > F.col("ta"), F.lit(False))
    return a.select(timed.alias("by_time"), F.when(timed, F.col("ta")).otherwise(F.col("la")).alias("lo"), F.when(timed, F.col("tb")).otherwise(F.col("lb")).alias("hi"))


def histogram(lines: DataFrame, selected: DataFrame | None = None, buckets: int = DEFAULT_BUCKETS, least: int = LEAST_BUCKETS, most: int = MOST_BUCKETS) -> DataFrame:
    """(bucket, x, cnt), zeros included. The domain comes from ``lines``; ``selected`` (default: all) is counted.

    Lines without a time are left out of a time domain. The domain is one row and meets the lines by broadcast; counts
    are summed in each task before they are shuffled.
    """
    buckets = max(least, min(most, buckets))
    d = F.broadcast(domain(lines))
    x = F.when(F.col("by_time"), F.col("ts_ms")).otherwise(F.col("line_no"))
    rows = (lines if selected is None else selected).crossJoin(d)  # one row on the right
    counts = rows.where(x.isNotNull()).groupBy(exact_bucket(x, buckets).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    all_buckets = lines.sparkSession.range(buckets).select(F.col("id").alias("bucket")).crossJoin(d)
    joined = all_buckets.join(F.broadcast(counts), F.col("bucket") == F.col("b"), "left")
    return joined.select("bucket", F.expr(f"lo + (greatest(hi - lo, 1) * bucket) div {buckets - 1}").alias("x"), F.coalesce("n", F.lit(0)).cast("long").alias("cnt"))


def exact_bucket(x: Column, buckets: int) -> Column:
    """The bucket of x in the domain of the columns lo, hi, in whole numbers; only x = hi falls into the last one."""
    inside = F.least(F.greatest(x - F.col("lo"), F.lit(0)), F.col("hi") - F.col("lo"))
    return _div(inside * (buckets - 1), F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))


def _div(a: Column, b: Column) -> Column:
    """Whole division."""
    return F.call_function("div", a, b)


def lane_histogram(lines: DataFrame, matched: DataFrame, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """(filter_id, bucket, cnt) of the matches of each filter; empty buckets have no row."""
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, buckets))
    x = F.when(F.col("by_time"), F.col("ts_ms")).otherwise(F.col("line_no"))
    rows = matched.crossJoin(F.broadcast(domain(lines)))
    return rows.where(x.isNotNull()).groupBy("filter_id", exact_bucket(x, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))


def points(lines: DataFrame, matched: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """(filter_id, line_no, x) of the matches, in a part of the domain if one is given."""
    x = F.when(F.col("by_time"), F.col("ts_ms")).otherwise(F.col("line_no"))
    out = matched.crossJoin(F.broadcast(domain(lines))).select("filter_id", "line_no", x.alias("x")).where("x is not null")
    return out.where(F.col("x").between(lo, hi)) if lo is not None else out


def lane_marks(lines: DataFrame, matched: DataFrame, lo: int, hi: int, buckets: int = DEFAULT_BUCKETS, most: int = 500) -> DataFrame:
    """(filter_id, kind, x, cnt): what a lane shows of the part of the domain from ``lo`` to ``hi``: a "point" for each place
    with matches, or "bar"s of the domain's buckets where more than ``most`` matches are visible."""
    visible = points(lines, matched, lo, hi)
    per = visible.groupBy("filter_id").agg(F.count(F.lit(1)).alias("__n"))
    shown = visible.join(per, "filter_id").crossJoin(F.broadcast(domain(lines)))
    bar = F.col("__n") > most
    x = F.when(bar, exact_bucket(F.col("x"), buckets)).otherwise(F.col("x"))
    return shown.groupBy("filter_id", F.when(bar, F.lit("bar")).otherwise(F.lit("point")).alias("kind"), x.alias("x")).agg(F.count(F.lit(1)).alias("cnt"))


def rebinned(buckets: DataFrame, start: int, end: int, columns: int) -> DataFrame:
    """(col, cnt): a histogram's buckets gathered into the columns of a zoomed view."""
    col = _div((F.col("x") - start) * columns, F.lit(end - start + 1))
    return buckets.where(F.col("x").between(start, end)).groupBy(col.alias("col")).agg(F.sum("cnt").alias("cnt"))


def with_previous(lines: DataFrame, columns: list[str]) -> DataFrame:
    """``lines`` with ``prev_<column>`` of the line before in the view.

    A window over a whole file would be one task. Lines are dealt by chunks of their number; the first line of a chunk
    takes the values of the last line of the chunk before that has any, from a table with one row for each chunk.
    """
    rows = lines.withColumn("__chunk", F.floor(F.col("line_no") / CHUNK).cast("long"))
    inside = Window.partitionBy("__chunk").orderBy("line_no")
    whole = F.struct(F.lit(True).alias("there"), *columns)
    last = rows.groupBy("__chunk").agg(F.max_by(whole, "line_no").alias("__last"))
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("__chunk", F.last("__last", True).over(before).alias("__carried"))
    out = rows.withColumn("__prev", F.lag(whole).over(inside)).join(carried, "__chunk")
    prev = F.coalesce("__prev", "__carried")
    return out.select(*lines.columns, *[prev[c].alias(f"prev_{c}") for c in columns], prev["there"].isNotNull().alias("has_prev"))


def time_gaps(lines: DataFrame, top: int = 3) -> DataFrame:
    """(line, gap_ms): the largest jumps of time from one line of the view to the next; earlier lines win ties."""
    gaps = with_previous(lines.select("line_no", "ts_ms"), ["ts_ms"]).where("ts_ms > prev_ts_ms")
    return gaps.select((F.col("line_no") + 1).alias("line"), (F.col("ts_ms") - F.col("prev_ts_ms")).alias("gap_ms")).orderBy(F.desc("gap_ms"), "line").limit(top)


def densest_minute(lines: DataFrame) -> DataFrame:
    """(start_ms, cnt): the fullest of the minutes counted from the first time; the earliest of equals."""
    first = F.broadcast(lines.agg(F.min("ts_ms").alias("t0")))
    minute = F.expr("t0 + ((ts_ms - t0) div 60000) * 60000")
    return lines.where("ts_ms is not null").crossJoin(first).groupBy(minute.alias("start_ms")).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "start_ms").limit(1)


def ranked_templates(lines: DataFrame, top: int | None = 5) -> DataFrame:
    """(template_id, cnt), most frequent first, ties by id."""
    out = lines.groupBy("template_id").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "template_id")
    return out if top is None else out.limit(top)


def error_templates(lines: DataFrame, templates: DataFrame, top: int = 20) -> DataFrame:
    """(template_id, pattern, cnt, error_lines): templates whose pattern speaks of errors, with the total of their lines."""
    bad = templates.where(F.lower("pattern").rlike("|".join(ERROR_WORDS))).select("template_id", "pattern")
    counts = lines.groupBy("template_id").agg(F.count(F.lit(1)).alias("cnt")).join(F.broadcast(bad), "template_id")
    total = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("error_lines"))
    return counts.crossJoin(F.broadcast(total)).orderBy(F.desc("cnt"), "template_id").limit(top)


def error_counts(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """One row (templates, lines): the templates in the view whose pattern speaks of errors, and their lines."""
    bad = templates.where(F.lower("pattern").rlike("|".join(ERROR_WORDS))).select("template_id")
    counts = lines.groupBy("template_id").agg(F.count(F.lit(1)).alias("n")).join(bad, "template_id")
    return counts.agg(F.count(F.lit(1)).alias("templates"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))


def summary(lines: DataFrame) -> DataFrame:
    """One row: lines, first and last time, templates, longest line, and an estimate of the sequence's size."""
    return lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.min("ts_ms").alias("ts_min_ms"),
        F.max("ts_ms").alias("ts_max_ms"),
        F.count_distinct("template_id").alias("templates"),
        F.max(F.octet_length("text")).cast("long").alias("max_line_width"),
        (F.count(F.lit(1)) * 40).alias("sequence_estimate_bytes"),
    )


def anomalies(lines: DataFrame, limit: int = 50) -> DataFrame:
    """(template_id, cnt, first_line, reasons): templates that are rare (a thousandth of the lines at most), first seen
    late (in the last tenth) or bursty (half of ten lines or more in one of 50 stretches of lines)."""
    d = F.broadcast(lines.agg(F.count(F.lit(1)).alias("m"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi")))
    rows = lines.select("template_id", "line_no").crossJoin(d)
    stretch = F.expr("((line_no - lo) * 50) div (hi - lo + 1)")
    parts = rows.groupBy("template_id", stretch.alias("__s")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    per = parts.groupBy("template_id").agg(F.sum("n").alias("cnt"), F.max("n").alias("peak"), F.min("first").alias("first_line")).crossJoin(d)
    reasons = F.array_compact(
        F.array(
            F.when(F.expr("cnt <= greatest(m div 1000, 1)"), F.lit("rare")),
            F.when(F.expr("first_line - lo >= ((hi - lo + 1) * 9) div 10"), F.lit("first_seen_late")),
            F.when(F.expr("cnt >= 10 and peak * 2 >= cnt"), F.lit("bursty")),
        )
    )
    flagged = per.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    return flagged.select("template_id", "cnt", "first_line", "reasons").orderBy(F.desc(F.size("reasons")), "cnt", "template_id").limit(limit)


def sample_ordinals(n: int, k: int, strategy: str = "first_last_random") -> list[int]:
    """Which of ``n`` lines to show: k of 1 to 10, the same at every call."""
    if strategy not in ("first", "even", "first_last_random"):
        raise ValueError(f"unknown strategy {strategy!r}")
    k = max(1, min(10, k))
    if n <= k:
        return list(range(n))
    if strategy == "first" or k == 1:
        return list(range(k))
    even = [i * (n - 1) // (k - 1) for i in range(k)]
    if strategy == "even":
        return even
    # The generator's start, factor and step.
    seed, chosen = 0x9E3779B97F4A7C15 ^ n, {0, n - 1}
    for _ in range(100):
        if len(chosen) == k:
            break
        seed = (seed * 6364136223846793005 + 1442695040888963407) % 2**64
        chosen.add((seed >> 33) % n)
    for i in even:
        if len(chosen) < k:
            chosen.add(i)
    return sorted(chosen)


def template_samples(lines: DataFrame, template_id: int, k: int = 3, strategy: str = "first_last_random") -> DataFrame:
    """The sampled lines of a template. Ordinals are taken chunk by chunk, so that a frequent template is no single task."""
    own = lines.where(F.col("template_id") == template_id).withColumn("__chunk", F.floor(F.col("line_no") / CHUNK).cast("long"))
    counts = own.groupBy("__chunk").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        raise ValueError(f"no line has template {template_id}")
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__chunk").orderBy("line_no")
    ranked = own.withColumn("__r", F.row_number().over(inside)).join(starts, "__chunk")
    picked = ranked.where((F.col("__start") + F.col("__r") - 1).isin(sample_ordinals(total, k, strategy)))
    return picked.select(*lines.columns).orderBy("line_no")
