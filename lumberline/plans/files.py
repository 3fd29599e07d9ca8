"""Registered queries over text files: logs written from the driver's events, then read, analysed and appended to.

Each log is one file in the shared folder, in the order of its lines; SQL says what analysing it must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, masking, timefmt
from ..operators import ingest, many, mining, search, sequence
from ..sources import spool, text as sources
from ..streaming import tail
from .catalogue import ANY_SQL, E_SQL, FILTERS, event_lines, register

N_SQL = f"{E_SQL}, n AS (SELECT row_number() OVER (ORDER BY line_no) - 1 AS line_no, line_no AS id, ts_ms, text, split_part(text, ' ', 1) AS type FROM l)"
MASKED_SQL = "type || ' user=<NUM> {\"k\": <NUM>}'"


def iso() -> Column:
    return F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def log_file(spark: SparkSession, sf_dir: str, line: Column, also: DataFrame | None = None) -> str:
    """A file with ``line`` of each event, in order; deleted when the driver ends."""
    rows = (event_lines(spark, sf_dir) if also is None else also).select("line_no", line.alias("value"))
    return spool.text_file(rows.repartition(1).sortWithinPartitions("line_no").select("value"))


@register("file_lines", f"WITH {N_SQL} SELECT line_no, text, CAST(strlen(text) AS BIGINT) AS n_bytes FROM n")
def file_lines(spark, sf_dir):
    path = log_file(spark, sf_dir, F.concat("text", F.when(F.col("line_no") % 3 == 0, "\r").otherwise("")))
    return sources.read_lines(spark, path).select("line_no", "text", F.col("n_bytes").cast("long").alias("n_bytes"))


def _traced(spark, sf_dir) -> ingest.AnalysedLog:
    """A log in which some lines are continuations, without a time."""
    line = F.when(F.col("line_no") % 7 == 3, F.concat(F.lit("  at "), F.col("line_no").cast("string"), F.lit(" "), "text")).otherwise(F.concat(iso(), F.lit(" "), "text"))
    return ingest.open_log(spark, log_file(spark, sf_dir, line))


@register("file_times", f"WITH {N_SQL} SELECT line_no, last_value(CASE WHEN id % 7 <> 3 THEN ts_ms END IGNORE NULLS) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS ts_ms FROM n")
def file_times(spark, sf_dir):
    return _traced(spark, sf_dir).lines.select("line_no", "ts_ms")


@register(
    "file_templates",
    f"""WITH {N_SQL}, t AS (SELECT line_no, CASE WHEN id % 7 = 3 THEN 'at <NUM> <*> user=<NUM> {{"k": <NUM>}}' ELSE {MASKED_SQL} END AS pattern FROM n)
SELECT CAST(row_number() OVER (ORDER BY min(line_no)) AS INTEGER) AS template_id, pattern, count(*) AS count, min(line_no) AS example_line FROM t GROUP BY pattern""",
)
def file_templates(spark, sf_dir):
    return _traced(spark, sf_dir).templates.where("template_id > 0").select("template_id", "pattern", "count", "example_line")


@register("file_summary", f"WITH {N_SQL} SELECT 'format: plain · date: ISO-8601' AS format, count(*) AS lines, min(CASE WHEN id % 7 <> 3 THEN ts_ms END) AS first_ms, max(CASE WHEN id % 7 <> 3 THEN ts_ms END) AS last_ms FROM n")
def file_summary(spark, sf_dir):
    log = _traced(spark, sf_dir)
    return log.lines.agg(F.count(F.lit(1)).alias("lines"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms")).select(F.lit(log.format_summary).alias("format"), "lines", "first_ms", "last_ms")


def _lines_of_formats() -> dict[str, Column]:
    text, kind, n = F.col("text"), F.substring_index("text", " ", 1), F.col("line_no").cast("string")
    micros = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss.SSS'456+0000'")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return {
        "json": say('{"time": "', iso(), '", "lvl": 30, "msg": "', kind, " by ", n, '"}'),
        "cef": say("CEF:0|Acme|Gate|2.4|", n, "|", kind, " seen|3|who=", n),
        "rfc5424": say("<134>1 ", iso(), " edge-9 ", kind, " 4410 id_31 - ", text),
        "logcat_brief": say("D/", kind, ": ", text),
        "os_log": say(micros, " 0x9f3e1d Error 0x0 777 5 org.tool: ", text),
        "oslog_console": say("[Disk:", kind, "] WARNING: ", text),
        "plain": say(iso(), " ", text),
    }


CONTENTS_SQL = {
    "json": "'lvl=<NUM> ' || type || ' by <NUM>'",
    "cef": "'CEF Acme Gate ' || id || ' ' || type || ' seen 3 who=<NUM>'",
    "rfc5424": f"'RFC5424 <HOST> ' || type || ' <NUM> id_<NUM> ' || {MASKED_SQL}",
    "logcat_brief": f"'D ' || type || ' ' || {MASKED_SQL}",
    "os_log": f"'OSLOG Error org.tool: ' || {MASKED_SQL}",
    "oslog_console": f"'Disk:' || type || ' WARNING ' || {MASKED_SQL}",
    "plain": MASKED_SQL,
}


@register("file_formats", f"WITH {N_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS format, line_no, {'ts_ms' if f in ('json', 'rfc5424', 'os_log', 'plain') else 'CAST(NULL AS BIGINT)'} AS ts_ms, {c} AS content FROM n" for f, c in CONTENTS_SQL.items()))
def file_formats(spark, sf_dir):
    """Format, time and content of a file in each format, as detected."""
    config, out = ingest.ParsingConfig(), None
    for line in _lines_of_formats().values():
        lines = sources.read_lines(spark, log_file(spark, sf_dir, line))
        sample, _ = ingest.head_of(lines, config)
        table = spark.createDataFrame([(x,) for x in sample], "text string")
        fmt = formats.detect_format(table)
        done = ingest.parsed(lines, fmt, ingest.detect_time(table, fmt.families, ()), (), config)
        rows = done.select(F.lit(fmt.name).alias("format"), "line_no", F.col("ts_raw_ms").alias("ts_ms"), "content")
        out = rows if out is None else out.union(rows)
    return out


@register("files_together", f"WITH {N_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS format, line_no, {'ts_ms' if f in ('json', 'rfc5424', 'os_log', 'plain') else 'CAST(NULL AS BIGINT)'} AS ts_ms, {c} AS content FROM n" for f, c in CONTENTS_SQL.items()))
def files_together(spark, sf_dir):
    """A file of each format, found, read and mined in one job."""
    found = many.open_logs(spark, [log_file(spark, sf_dir, line) for line in _lines_of_formats().values()])
    return found.lines.join(F.broadcast(found.formats.select("doc_id", "format")), "doc_id").select("format", "line_no", "ts_ms", "content")


@register("stream_templates", f"WITH {N_SQL} SELECT CAST(row_number() OVER (ORDER BY min(line_no)) AS INTEGER) AS template_id, {MASKED_SQL} AS pattern, count(*) AS count, min(line_no) AS example_line FROM n GROUP BY 2")
def stream_templates(spark, sf_dir):
    """Templates of a file that a stream follows: analysed by batches, each committed as a version of the log, and the query
    begun anew between two of them."""
    rows = event_lines(spark, sf_dir).select("line_no", F.concat(iso(), F.lit(" "), "text").alias("value"))
    half = rows.agg(F.max("line_no")).first()[0] // 2
    folder = spool.temporary(spark, "stream")
    for part in (rows.where(F.col("line_no") <= half), rows):
        path = spool.local_copy(spool.text_file(part.repartition(1).sortWithinPartitions("line_no").select("value")), f"{folder}/followed.log")
        query = tail.tail(spark, path, 1 << 18).writeStream.foreachBatch(tail.TailAnalysis(spark, f"{folder}/log").batch).option("checkpointLocation", f"{folder}/checkpoint").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return tail.TailAnalysis(spark, f"{folder}/log").log.templates.where("template_id > 0").select("template_id", "pattern", "count", "example_line")


@register("file_header", "SELECT * FROM (VALUES (0, '<NUM>'), (1, NULL), (2, '<NUM>')) t(position, mask)")
def file_header(spark, sf_dir):
    """The masks learnt for the head of an app's lines: process and thread, a constant, and the place in a source file."""
    n = F.col("line_no")
    line = F.concat(iso(), F.lit(" Shop["), (n % 4 + 4711).cast("string"), F.lit(":"), n.cast("string"), F.lit("] <INFO> Cart.swift:"), n.cast("string"), F.lit(" item"), n.cast("string"), F.lit("x "), "text")
    header = ingest.open_log(spark, log_file(spark, sf_dir, line)).header
    return spark.createDataFrame(list(enumerate(header))[:3], "position int, mask string")


OWN = timefmt.CustomFormat("own", r"<(?P<day>\d+)\|(?P<month>\d+)\|(?P<year>\d+) (?P<hour>\d+)h(?P<min>\d+)m(?P<sec>\d+)s(?P<ms>\d+)>")


def _own_times(spark, sf_dir) -> ingest.AnalysedLog:
    at = F.timestamp_millis("ts_ms")
    line = F.concat(F.date_format(at, "'<'dd|MM|yyyy HH'h'mm'm'ss's'"), (F.col("ts_ms") % 1000).cast("string"), F.lit("> "), "text")
    return ingest.open_log(spark, log_file(spark, sf_dir, line), custom=(OWN,))


@register("file_custom_times", f"WITH {N_SQL} SELECT line_no, ts_ms FROM n")
def file_custom_times(spark, sf_dir):
    return _own_times(spark, sf_dir).lines.select("line_no", "ts_ms")


@register("file_custom_templates", f"WITH {N_SQL} SELECT {MASKED_SQL} AS pattern, count(*) AS count, min(line_no) AS example_line FROM n GROUP BY 1")
def file_custom_templates(spark, sf_dir):
    return _own_times(spark, sf_dir).templates.where("template_id > 0").select("pattern", "count", "example_line")


@register("file_appended", f"WITH {N_SQL}, f AS (SELECT type, CAST(row_number() OVER (ORDER BY min(line_no)) AS INTEGER) AS template_id FROM n GROUP BY 1) SELECT line_no, ts_ms, template_id FROM n JOIN f USING (type)")
def file_appended(spark, sf_dir):
    """A log opened with a tenth of its lines, then appended to."""
    lines = sources.read_lines(spark, log_file(spark, sf_dir, F.concat(iso(), F.lit(" "), "text")))
    cut = lines.count() // 10
    log = ingest.append(ingest.analyse(lines.where(F.col("line_no") < cut)), lines.where(F.col("line_no") >= cut))
    return log.lines.select("line_no", "ts_ms", "template_id")


@register("file_find", f"WITH {N_SQL} SELECT line_no, ts_ms FROM n WHERE {ANY_SQL}")
def file_find(spark, sf_dir):
    log = ingest.open_log(spark, log_file(spark, sf_dir, F.concat(iso(), F.lit(" "), "text")))
    return search.filtered(log.lines, FILTERS).select("line_no", "ts_ms")


@register("drain_budget", f"WITH {N_SQL}, f AS (SELECT type, row_number() OVER (ORDER BY min(line_no)) AS nth FROM n GROUP BY 1) SELECT id AS line_no, CAST(CASE WHEN nth <= 3 THEN nth ELSE 0 END AS INTEGER) AS template_id FROM n JOIN f USING (type)")
def drain_budget(spark, sf_dir):
    """With a budget of four templates, the blank one included, later kinds of lines get the blank one."""
    lines = event_lines(spark, sf_dir).select(F.lit("e").alias("doc_id"), "line_no", masking.masked_lines(F.col("text")).alias("content"))
    return mining.mine(lines, mining.DrainConfig(max_clusters=4))[0].select("line_no", "template_id")


GAP_SQL = f"{E_SQL}, g AS (SELECT line_no, ts_ms - lag(ts_ms) OVER (ORDER BY line_no) AS g FROM l)"


def _in_unit(unit: str) -> str:
    return f"format('{{:.1f}}', {unit})"


@register(
    "durations_human",
    f"""WITH {GAP_SQL} SELECT line_no, CASE WHEN g >= 3600000 THEN g // 3600000 || 'h' || CASE WHEN g // 60000 % 60 > 0 THEN ' ' || g // 60000 % 60 || 'm' ELSE '' END
WHEN g >= 60000 THEN g // 60000 || 'm' || CASE WHEN g // 1000 % 60 > 0 THEN ' ' || g // 1000 % 60 || 'sec' ELSE '' END
WHEN g >= 1000 THEN {_in_unit('CAST(g AS DOUBLE) / 1000.0::DOUBLE')} || 'sec' ELSE greatest(g, 0) || 'ms' END AS length FROM g WHERE g IS NOT NULL""",
)
def durations_human(spark, sf_dir):
    return _gaps(spark, sf_dir).select("line_no", sequence.format_human_ms(F.col("gap")).alias("length"))


@register(
    "durations_pin",
    f"""WITH {GAP_SQL}, s AS (SELECT line_no, g * 977 AS g, CAST(abs(g * 977) AS DOUBLE) / 1000.0::DOUBLE AS s FROM g WHERE g IS NOT NULL)
SELECT line_no, CASE WHEN abs(g) < 1000 THEN g || ' ms' WHEN s < 60 THEN {_in_unit('s')} || ' sec' WHEN s / 60.0::DOUBLE < 60 THEN {_in_unit('s / 60.0::DOUBLE')} || ' min'
WHEN s / 60.0::DOUBLE / 60.0::DOUBLE < 24 THEN {_in_unit('s / 60.0::DOUBLE / 60.0::DOUBLE')} || ' hr' ELSE {_in_unit('s / 60.0::DOUBLE / 60.0::DOUBLE / 24.0::DOUBLE')} || ' days' END AS length FROM s""",
)
def durations_pin(spark, sf_dir):
    return _gaps(spark, sf_dir).select("line_no", sequence.format_pin_ms(F.col("gap") * 977).alias("length"))


def _gaps(spark, sf_dir) -> DataFrame:
    from ..operators import analysis

    seen = analysis.with_previous(event_lines(spark, sf_dir).select("line_no", "ts_ms"), ["ts_ms"]).where("prev_ts_ms is not null")
    return seen.select("line_no", (F.col("ts_ms") - F.col("prev_ts_ms")).alias("gap"))


@register(
    "highlights",
    f"""WITH {E_SQL}, p AS (SELECT line_no, instr(text, ' user=') AS p FROM l)
SELECT line_no, CAST(p AS INTEGER) AS start, CAST(p + 4 AS INTEGER) AS stop, 'search' AS kind FROM p
UNION ALL SELECT line_no, CAST(p + 4 AS INTEGER), CAST(p + 5 AS INTEGER), 'keyword' FROM p
UNION ALL SELECT line_no, 0, CAST(p AS INTEGER), 'filter' FROM p JOIN l USING (line_no) WHERE starts_with(text, 'click user')""",
)
def highlights(spark, sf_dir):
    """Of overlapping matches the later kinds keep what is not covered."""
    spans = sequence.highlight_spans(F.col("text"), "user", "SER=", ["click user"])
    return event_lines(spark, sf_dir).select("line_no", F.inline(spans))


@register(
    "occurrence_texts",
    f"""WITH {E_SQL}, m AS (SELECT line_no, ts_ms, row_number() OVER w AS k, count(*) OVER () AS n, lag(line_no) OVER w AS b, lead(line_no) OVER w AS a FROM l WHERE contains(text, 'error') WINDOW w AS (ORDER BY line_no))
SELECT line_no, 'Occurrence ' || k || ' / ' || n || CASE WHEN b IS NOT NULL THEN ' | prev ' || line_no - b || ' lines ago' ELSE '' END || CASE WHEN a IS NOT NULL THEN ' | next ' || a - line_no || ' lines after' ELSE '' END AS label FROM m""",
)
def occurrence_texts(spark, sf_dir):
    matched = search.find(event_lines(spark, sf_dir), "error").select(F.lit(0).alias("filter_id"), "line_no", "ts_ms")
    return sequence.occurrence_text(matched, by_time=False).select("line_no", "label")
