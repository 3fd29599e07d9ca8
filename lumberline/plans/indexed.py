"""Registered queries over stored logs: ranges, places of times, timelines and filters from what was written with the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bitmaps, search
from ..operators.ingest import analyse
from ..operators.timecounts import TimeCounts
from ..sources import logsource, spool
from ..sources.stored import StoredLines, completed, store, stored
from ..sources.versions import LogFolder
from .catalogue import ANY_SQL, BUCKET, DOMAIN_SQL, E_SQL, FILTER_CASES, FILTERS, ORDERS_SQL, event_lines, histogram_sql, order_lines, register

MIDDLE_SQL = "m AS (SELECT max(line_no) * 2 // 5 AS lo, max(line_no) * 3 // 5 AS hi FROM l)"


def _stored_events(spark, sf_dir) -> StoredLines:
    return stored(event_lines(spark, sf_dir).withColumn("doc_id", F.lit("e")))


def _middle(lines: DataFrame) -> tuple[int, int]:
    last = lines.agg(F.max("line_no")).first()[0]
    return last * 2 // 5, last * 3 // 5


@register("stored_range", f"WITH {E_SQL}, {MIDDLE_SQL} SELECT line_no, ts_ms, text FROM l CROSS JOIN m WHERE line_no >= lo AND line_no < hi")
def stored_range(spark, sf_dir):
    """The middle fifth of a log, from the chunks that hold it."""
    log = _stored_events(spark, sf_dir)
    return log.range(*_middle(log.chunks.select(F.col("last_line").alias("line_no")))).select("line_no", "ts_ms", "text")


@register("log_source_range", f"WITH {E_SQL}, {MIDDLE_SQL} SELECT line_no, ts_ms, text FROM l CROSS JOIN m WHERE line_no >= lo AND line_no < hi AND ts_ms > 0")
def log_source_range(spark, sf_dir):
    """The middle fifth of a log that stands in a folder of versions, by the data source that prunes by chunks."""
    rows = event_lines(spark, sf_dir).select(F.lit("e").alias("doc_id"), "line_no", F.concat(F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("\u0001"), "text").alias("text"), F.octet_length("text").alias("n_bytes"))
    folder = LogFolder(spark, spool.temporary(spark, "versions"))
    with folder.writing():
        log = analyse(rows)
    folder.commit(log)
    logsource.register(spark)
    lo, hi = _middle(log.stored.chunks.select(F.col("last_line").alias("line_no")))
    found = spark.read.format(logsource.LogSource.name()).option("folder", folder.folder).load().where((F.col("line_no") >= lo) & (F.col("line_no") < hi) & (F.col("ts_ms") > 0))
    return found.select("line_no", "ts_ms", F.substring_index("text", "\u0001", -1).alias("text"))


PROBES_SQL = "d AS (SELECT min(ts_ms) AS a, max(ts_ms) AS b FROM l), p AS (SELECT a + (b - a) * r.range // 8 + (r.range % 3 - 1) AS probe_ms FROM d CROSS JOIN range(9) r)"


@register(
    "stored_time_bounds",
    f"""WITH {ORDERS_SQL}, {PROBES_SQL} SELECT probe_ms, (SELECT min(line_no) FROM l WHERE ts_ms >= probe_ms) AS first_line, (SELECT max(line_no) FROM l WHERE ts_ms <= probe_ms) AS last_line FROM p""",
)
def stored_time_bounds(spark, sf_dir):
    """The first line not before and the last line not after nine times, in a log whose times are in no order."""
    log = stored(order_lines(spark, sf_dir).withColumn("doc_id", F.lit("o")))
    lo, hi = log.chunks.agg(F.min("lo_ms"), F.max("hi_ms")).first()
    probes = [lo + (hi - lo) * i // 8 + (i % 3 - 1) for i in range(9)]
    rows = [(p, log.first_at_or_after(p), log.last_at_or_before(p)) for p in probes]
    return spark.createDataFrame(rows, "probe_ms bigint, first_line bigint, last_line bigint")


@register("stored_completed", f"WITH {E_SQL} SELECT line_no, last_value(CASE WHEN line_no % 5 = 2 THEN ts_ms END IGNORE NULLS) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS ts_ms, CASE WHEN line_no % 3 > 0 THEN template_id ELSE 0 END AS template_id FROM l")
def stored_completed(spark, sf_dir):
    """Filled times and template ids that come into a log as it is written."""
    lines = event_lines(spark, sf_dir).withColumn("doc_id", F.lit("e"))
    births = lines.where("line_no % 3 > 0").select("doc_id", "line_no", "template_id")
    raw = lines.select("doc_id", "line_no", "text", F.when(F.col("line_no") % 5 == 2, F.col("ts_ms")).alias("ts_raw_ms"))
    return store(completed(raw, births)).lines.select("line_no", "ts_ms", "template_id")


@register("stored_zone_map", f"WITH {E_SQL} SELECT line_no // 65536 AS chunk, count(*) AS lines, min(ts_ms) AS lo_ms, max(ts_ms) AS hi_ms, min(line_no) AS first_line, max(line_no) AS last_line FROM l GROUP BY 1")
def stored_zone_map(spark, sf_dir):
    return _stored_events(spark, sf_dir).chunks.select("chunk", "lines", "lo_ms", "hi_ms", "first_line", "last_line")


@register("prefix_timeline", histogram_sql(E_SQL, "true", 2048))
def prefix_timeline(spark, sf_dir):
    return TimeCounts.of(event_lines(spark, sf_dir)).histogram(2048)


@register("prefix_timeline_orders", histogram_sql(ORDERS_SQL, "true", 256))
def prefix_timeline_orders(spark, sf_dir):
    return TimeCounts.of(order_lines(spark, sf_dir)).histogram(256)


@register("prefix_timeline_lanes", f"WITH {E_SQL}, {DOMAIN_SQL}, m AS (SELECT unnest([{FILTER_CASES}]) AS filter_id, ts_ms FROM l) SELECT filter_id, {BUCKET.format(m=511)} AS bucket, count(*) AS cnt FROM m CROSS JOIN b WHERE filter_id IS NOT NULL GROUP BY 1, 2")
def prefix_timeline_lanes(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    found = TimeCounts.of(lines, search.matches(lines, FILTERS)).histograms(512).where("lane >= 0 and cnt > 0")
    return found.select(F.col("lane").alias("filter_id"), F.col("bucket").cast("long").alias("bucket"), "cnt")


@register("prefix_zoom", f"WITH {E_SQL}, d AS (SELECT min(ts_ms) + (max(ts_ms) - min(ts_ms)) // 3 AS a, min(ts_ms) + (max(ts_ms) - min(ts_ms)) // 2 AS b FROM l), h AS (SELECT (ts_ms - a) * 700 // (b - a + 1) AS col, count(*) AS cnt FROM l CROSS JOIN d WHERE ts_ms BETWEEN a AND b GROUP BY 1) SELECT CAST(n.range AS INTEGER) AS col, coalesce(cnt, 0) AS cnt FROM range(700) n LEFT JOIN h ON h.col = n.range")
def prefix_zoom(spark, sf_dir):
    """A part of the timeline, anew from the counts and not from buckets that were made for the whole."""
    counts = TimeCounts.of(event_lines(spark, sf_dir))
    span = counts.hi - counts.lo
    return counts.zoomed(counts.lo + span // 3, counts.lo + span // 2, 700)


@register("prefix_extended", histogram_sql(E_SQL, "true", 777))
def prefix_extended(spark, sf_dir):
    """Counts of the first third of a log, taken further by the second and the last."""
    lines = event_lines(spark, sf_dir)
    part = F.expr("line_no % 3")
    return TimeCounts.of(lines.where(part == 0)).extended(lines.where(part == 1)).extended(lines.where(part == 2)).histogram(777)


@register("bitmap_lanes", f"WITH {E_SQL} SELECT line_no FROM l WHERE contains(text, 'user=4') OR NOT {ANY_SQL}")
def bitmap_lanes(spark, sf_dir):
    return bitmaps.numbers(bitmaps.MatchBitmaps(event_lines(spark, sf_dir)).lanes(FILTERS, [False, True, False], True))


@register("bitmap_all_of", f"WITH {E_SQL} SELECT line_no FROM l WHERE contains(text, 'error') AND contains(text, 'user=4')")
def bitmap_all_of(spark, sf_dir):
    return bitmaps.numbers(bitmaps.MatchBitmaps(event_lines(spark, sf_dir)).all_of(FILTERS[:2]))


@register("bitmap_hits", f"WITH {E_SQL}, {MIDDLE_SQL}, f AS (SELECT unnest([{FILTER_CASES}]) AS filter_id FROM l CROSS JOIN m WHERE line_no >= lo AND line_no < hi) SELECT filter_id, count(*) AS hits FROM f WHERE filter_id IS NOT NULL GROUP BY 1")
def bitmap_hits(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return bitmaps.MatchBitmaps(lines).hits(FILTERS, *_middle(lines))


@register("bitmap_page", f"WITH {E_SQL} SELECT line_no, text FROM l WHERE {ANY_SQL} ORDER BY line_no LIMIT 40 OFFSET 60")
def bitmap_page(spark, sf_dir):
    """A page of a filtered view, from the bitmaps and the chunks of its lines."""
    log = _stored_events(spark, sf_dir)
    view = bitmaps.MatchBitmaps(log.lines).lanes(FILTERS, [True] * len(FILTERS), False)
    return log.at(bitmaps.page_numbers(view, 60, 40)).select("line_no", "text")


@register("bitmap_appended", f"WITH {E_SQL} SELECT line_no FROM l WHERE {ANY_SQL}")
def bitmap_appended(spark, sf_dir):
    """Bitmaps of the first half of a log, taken further by scanning the other half only."""
    lines = event_lines(spark, sf_dir)
    half = lines.agg(F.max("line_no")).first()[0] // 2
    maps = bitmaps.MatchBitmaps(lines.where(F.col("line_no") < half))
    maps.add(FILTERS)
    return bitmaps.numbers(maps.extended(lines, lines.where(F.col("line_no") >= half)).lanes(FILTERS, [True] * len(FILTERS), False))


