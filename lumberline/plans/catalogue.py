"""The registered queries over the driver tables, and their DuckDB SQL.

Views: E, one line for each event; D, the lines of documents; C, conversations in turn order; O and L, orders and line
items by date as sparse timelines. Line numbers are keys that the tables have, so that no view needs a global sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats, masking, timefmt
from ..operators import analysis, mining, search, sequence
from ..sources import text as sources

TYPES = ("click", "error", "purchase", "signup", "view")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

E_SQL = f"""l AS (SELECT event_id AS line_no, epoch_us(ts) // 1000 AS ts_ms, event_type || ' user=' || CAST(user_id AS VARCHAR) || ' ' || props AS text,
  CAST(list_position({list(TYPES)}, event_type) AS INTEGER) AS template_id FROM events)"""
D_SQL = r"""l AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, regexp_replace(s[i], '\r+$', '') AS text FROM (
  SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS s, unnest(range(1, len(string_split(regexp_replace(text, '\n$', ''), chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))"""
DOMAIN_SQL = "b AS (SELECT min(ts_ms) AS lo, max(ts_ms) AS hi FROM l)"
BUCKET = "CAST((ts_ms - lo) * {m} // greatest(hi - lo, 1) AS BIGINT)"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    """Milliseconds since 1970, microseconds cut towards it as by the SQL's ``//``."""
    at = ts.cast("timestamp_ntz").cast("timestamp")
    return F.unix_millis(at) + F.when(F.unix_micros(at) % 1000 < 0, 1).otherwise(0)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.concat(F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" "), F.col("props"))
    template = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")).cast("int")
    return e.select(F.col("event_id").alias("line_no"), millis(F.col("ts")).alias("ts_ms"), text.alias("text"), template.alias("template_id"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.split_documents(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "text")


FILTERS = ["error", "user=4", '"k": 6']
FILTER_CASES = "CASE WHEN contains(text, 'error') THEN 0 END, CASE WHEN contains(text, 'user=4') THEN 1 END, CASE WHEN contains(text, '\"k\": 6') THEN 2 END"
ANY_SQL = "(contains(text, 'error') OR contains(text, 'user=4') OR contains(text, '\"k\": 6'))"
T0, T1 = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
MS0, MS1 = timefmt.parse_time_param(T0), timefmt.parse_time_param(T1)

# ---- scans, filters, lanes, ranges ----


@register("find_count_window", f"WITH {E_SQL} SELECT count(*) AS total FROM l WHERE contains(text, 'error') AND ts_ms BETWEEN {MS0} AND {MS1}")
def find_count_window(spark, sf_dir):
    return search.hit_summary(event_lines(spark, sf_dir), "error", MS0, MS1).select("total")


@register("find_first_last", f"WITH {E_SQL} SELECT count(*) AS total, min(ts_ms) AS first_seen_ms, max(ts_ms) AS last_seen_ms FROM l WHERE contains(text, 'purchase')")
def find_first_last(spark, sf_dir):
    return search.hit_summary(event_lines(spark, sf_dir), " purchase ")


@register("find_page", f"WITH {E_SQL} SELECT line_no + 1 AS line, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS time, template_id, text FROM l WHERE contains(text, 'signup') ORDER BY line_no LIMIT 50 OFFSET 25")
def find_page(spark, sf_dir):
    return search.payload(search.page(search.find(event_lines(spark, sf_dir), "signup"), 25, 50))


@register("find_refs", f"WITH {E_SQL} SELECT line_no + 1 AS line, ts_ms FROM l WHERE contains(text, 'user=7') ORDER BY line_no LIMIT 2000")
def find_refs(spark, sf_dir):
    hits = search.page(search.find(event_lines(spark, sf_dir), "user=7"), 0, 2000)
    return hits.select((F.col("line_no") + 1).alias("line"), "ts_ms")


@register("find_ci_subset", f"WITH {D_SQL} SELECT doc_id, line_no FROM l WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the thing') AND contains(text, 'and')")
def find_ci_subset(spark, sf_dir):
    subset = search.filtered(document_lines(spark, sf_dir), ["and"])
    return search.find(subset, "THE Thing", fold_case=True).select("doc_id", "line_no")


@register("filters_matches_long", f"WITH {E_SQL} SELECT filter_id, line_no, ts_ms FROM (SELECT unnest([{FILTER_CASES}]) AS filter_id, line_no, ts_ms FROM l) WHERE filter_id IS NOT NULL")
def filters_matches_long(spark, sf_dir):
    return search.matches(event_lines(spark, sf_dir), FILTERS)


@register("filtered_view", f"WITH {E_SQL} SELECT line_no, text FROM l WHERE {ANY_SQL}")
def filtered_view(spark, sf_dir):
    return search.filtered(event_lines(spark, sf_dir), FILTERS).select("line_no", "text")


@register("everything_else", f"WITH {E_SQL} SELECT line_no, text FROM l WHERE NOT {ANY_SQL}")
def everything_else(spark, sf_dir):
    return search.everything_else(event_lines(spark, sf_dir), FILTERS).select("line_no", "text")


@register("lane_visible", f"WITH {E_SQL} SELECT line_no FROM l WHERE contains(text, 'user=4') OR NOT {ANY_SQL}")
def lane_visible(spark, sf_dir):
    return search.lanes(event_lines(spark, sf_dir), FILTERS, [False, True, False], True).select("line_no")


@register("hits_in_view", f"WITH {E_SQL} SELECT count(*) AS cnt FROM l WHERE {ANY_SQL} AND contains(text, 'click')")
def hits_in_view(spark, sf_dir):
    return search.find(search.filtered(event_lines(spark, sf_dir), FILTERS), "click").agg(F.count(F.lit(1)).alias("cnt"))


@register("range_by_line", f"WITH {E_SQL} SELECT line_no, ts_ms FROM l WHERE line_no >= 99 AND line_no < 1500")
def range_by_line(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return search.resolve_range(lines, 100, 1500).lines(lines).select("line_no", "ts_ms")


@register(
    "range_by_time",
    f"WITH {E_SQL}, b AS (SELECT coalesce(min(CASE WHEN ts_ms >= {MS0} THEN line_no END), count(*) - 1) AS a, coalesce(max(CASE WHEN ts_ms <= {MS1} THEN line_no END), 0) AS z FROM l) "
    "SELECT count(*) AS cnt, min(line_no) AS first_line, max(line_no) AS last_line FROM l, b WHERE line_no BETWEEN a AND z",
)
def range_by_time(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    inside = search.resolve_range(lines, T0, T1).lines(lines)
    return inside.agg(F.count(F.lit(1)).alias("cnt"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@register("trim_counts", f"WITH {E_SQL} SELECT template_id, count(*) AS cnt, min(line_no - 200) AS first_line FROM l WHERE line_no >= 200 AND line_no < 900 GROUP BY template_id")
def trim_counts(spark, sf_dir):
    return search.trimmed(event_lines(spark, sf_dir), 200, 900).groupBy("template_id").agg(F.count(F.lit(1)).alias("cnt"), F.min("line_no").alias("first_line"))


@register("raw_log_page", f"WITH {E_SQL} SELECT line_no + 1 AS line, text FROM l WHERE line_no >= 299 AND line_no < 900 ORDER BY line_no LIMIT 100")
def raw_log_page(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return search.page(search.Range(299, 900).lines(lines), 0, 100).select((F.col("line_no") + 1).alias("line"), "text")


@register("truncated_lines", f"WITH {D_SQL} SELECT doc_id, line_no, length(text) AS width FROM l WHERE strlen(text) > 1000")
def truncated_lines(spark, sf_dir):
    long = document_lines(spark, sf_dir).where(F.octet_length("text") > 1000)
    return long.where(F.octet_length(search.truncated(F.col("text"))) <= 1003).select("doc_id", "line_no", F.length("text").cast("long").alias("width"))


# ---- timelines ----


def histogram_sql(view: str, where: str, buckets: int) -> str:
    return f"""WITH {view}, {DOMAIN_SQL},
h AS (SELECT {BUCKET.format(m=buckets - 1)} AS bucket, count(*) AS cnt FROM l CROSS JOIN b WHERE ts_ms IS NOT NULL AND {where} GROUP BY 1)
SELECT n.range AS bucket, lo + (greatest(hi - lo, 1) * n.range) // {buckets - 1} AS x, coalesce(cnt, 0) AS cnt FROM range({buckets}) n CROSS JOIN b LEFT JOIN h ON h.bucket = n.range"""


@register("timeline_density", histogram_sql(E_SQL, "true", 2048))
def timeline_density(spark, sf_dir):
    return analysis.histogram(event_lines(spark, sf_dir))


@register("histogram_keyword", histogram_sql(E_SQL, "contains(text, 'error')", 50))
def histogram_keyword(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return analysis.histogram(lines, search.find(lines, "error"), 50, most=1024)


@register("histogram_template", histogram_sql(E_SQL, "template_id = 3", 100))
def histogram_template(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return analysis.histogram(lines, lines.where("template_id = 3"), 100, most=1024)


@register("histogram_sequence", histogram_sql(E_SQL.replace("epoch_us(ts) // 1000 AS ts_ms", "event_id AS ts_ms"), "contains(text, 'view')", 64))
def histogram_sequence(spark, sf_dir):
    lines = event_lines(spark, sf_dir).withColumn("ts_ms", F.lit(None).cast("long"))
    return analysis.histogram(lines, search.find(lines, "view"), 64)


ORDERS_SQL = "l AS (SELECT o_orderkey AS line_no, epoch_us(o_orderdate) // 1000 AS ts_ms, o_orderpriority AS text FROM orders)"


def order_lines(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), millis(F.col("o_orderdate")).alias("ts_ms"), F.col("o_orderpriority").alias("text"))


@register("timeline_orders", histogram_sql(ORDERS_SQL, "true", 256))
def timeline_orders(spark, sf_dir):
    return analysis.histogram(order_lines(spark, sf_dir), buckets=256)


@register("timeline_lineitem", histogram_sql("l AS (SELECT epoch_us(l_shipdate) // 1000 AS ts_ms FROM lineitem)", "true", 512))
def timeline_lineitem(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(millis(F.col("l_shipdate")).alias("ts_ms"), F.col("l_orderkey").alias("line_no"))
    return analysis.histogram(items, buckets=512)


@register("timeline_filters", f"WITH {E_SQL}, {DOMAIN_SQL}, m AS (SELECT unnest([{FILTER_CASES}]) AS filter_id, ts_ms FROM l) SELECT filter_id, {BUCKET.format(m=99)} AS bucket, count(*) AS cnt FROM m CROSS JOIN b WHERE filter_id IS NOT NULL GROUP BY 1, 2")
def timeline_filters(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return analysis.lane_histogram(lines, search.matches(lines, FILTERS), 100)


@register("points_in_range", f"WITH {E_SQL}, m AS (SELECT unnest([{FILTER_CASES}]) AS filter_id, line_no, ts_ms AS x FROM l) SELECT filter_id, count(*) AS cnt FROM m WHERE filter_id IS NOT NULL AND x BETWEEN {MS0} AND {MS1} GROUP BY 1")
def points_in_range(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return analysis.points(lines, search.matches(lines, FILTERS), MS0, MS1).groupBy("filter_id").agg(F.count(F.lit(1)).alias("cnt"))


@register(
    "lane_marks",
    f"""WITH {E_SQL}, {DOMAIN_SQL}, m AS (SELECT unnest([{FILTER_CASES}]) AS filter_id, ts_ms FROM l), v AS (SELECT filter_id, ts_ms, count(*) OVER (PARTITION BY filter_id) AS n FROM m WHERE filter_id IS NOT NULL AND ts_ms BETWEEN {MS0} AND {MS1})
SELECT filter_id, CASE WHEN n > 60 THEN 'bar' ELSE 'point' END AS kind, CASE WHEN n > 60 THEN {BUCKET.format(m=299)} ELSE ts_ms END AS x, count(*) AS cnt FROM v CROSS JOIN b GROUP BY 1, 2, 3""",
)
def lane_marks(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return analysis.lane_marks(lines, search.matches(lines, FILTERS), MS0, MS1, 300, 60)


@register("rebin", f"SELECT CAST((x - {MS0}) * 40 // {MS1 - MS0 + 1} AS BIGINT) AS col, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({histogram_sql(E_SQL, 'true', 2048)}) WHERE x BETWEEN {MS0} AND {MS1} GROUP BY 1")
def rebin(spark, sf_dir):
    return analysis.rebinned(analysis.histogram(event_lines(spark, sf_dir)), MS0, MS1, 40)


# ---- gaps, minutes, summaries, templates ----


@register("time_gaps_top3", f"WITH {E_SQL}, g AS (SELECT line_no + 1 AS line, ts_ms - lag(ts_ms) OVER (ORDER BY line_no) AS gap_ms FROM l) SELECT * FROM g WHERE gap_ms > 0 ORDER BY gap_ms DESC, line LIMIT 3")
def time_gaps_top3(spark, sf_dir):
    return analysis.time_gaps(event_lines(spark, sf_dir))


@register("time_gaps_filtered", f"WITH {E_SQL}, g AS (SELECT line_no + 1 AS line, ts_ms - lag(ts_ms) OVER (ORDER BY line_no) AS gap_ms FROM l WHERE {ANY_SQL}) SELECT * FROM g WHERE gap_ms > 0 ORDER BY gap_ms DESC, line LIMIT 3")
def time_gaps_filtered(spark, sf_dir):
    return analysis.time_gaps(search.filtered(event_lines(spark, sf_dir), FILTERS))


@register("densest_minute", f"WITH {E_SQL}, t AS (SELECT min(ts_ms) AS t0 FROM l) SELECT t0 + (ts_ms - t0) // 60000 * 60000 AS start_ms, count(*) AS cnt FROM l, t GROUP BY 1 ORDER BY cnt DESC, start_ms LIMIT 1")
def densest_minute(spark, sf_dir):
    return analysis.densest_minute(event_lines(spark, sf_dir))


@register("summary_stats", f"WITH {E_SQL} SELECT count(*) AS lines, min(ts_ms) AS ts_min_ms, max(ts_ms) AS ts_max_ms, count(DISTINCT template_id) AS templates, CAST(max(strlen(text)) AS BIGINT) AS max_line_width, count(*) * 40 AS sequence_estimate_bytes FROM l")
def summary_stats(spark, sf_dir):
    return analysis.summary(event_lines(spark, sf_dir))


@register("event_type_counts", f"WITH {E_SQL} SELECT template_id, count(*) AS cnt FROM l GROUP BY 1 ORDER BY cnt DESC, template_id LIMIT 5")
def event_type_counts(spark, sf_dir):
    return analysis.ranked_templates(event_lines(spark, sf_dir))


def type_templates(spark) -> DataFrame:
    return spark.createDataFrame([(i + 1, t, 0, 0) for i, t in enumerate((*TYPES, "never"))], "template_id int, pattern string, count bigint, example_line bigint")


@register("template_counts_all", f"WITH {E_SQL}, t AS (SELECT CAST(i AS INTEGER) AS template_id, p AS pattern FROM (VALUES (1, 'click'), (2, 'error'), (3, 'purchase'), (4, 'signup'), (5, 'view'), (6, 'never')) v(i, p)) SELECT t.template_id, pattern, count(l.line_no) AS count FROM t LEFT JOIN l ON l.template_id = t.template_id AND contains(l.text, 'user=1') GROUP BY 1, 2")
def template_counts_all(spark, sf_dir):
    return mining.template_counts(search.find(event_lines(spark, sf_dir), "user=1"), type_templates(spark)).select("template_id", "pattern", "count")


@register("error_templates", f"WITH {E_SQL} SELECT template_id, 'error' AS pattern, count(*) AS cnt, count(*) AS error_lines FROM l WHERE template_id = 2 GROUP BY 1")
def error_templates(spark, sf_dir):
    return analysis.error_templates(event_lines(spark, sf_dir), type_templates(spark))


# the key value of an event as its template: many templates, some rare
K_SQL = "l AS (SELECT event_id AS line_no, epoch_us(ts) // 1000 AS ts_ms, CAST(user_id AS INTEGER) AS template_id FROM events)"


@register(
    "rare_late_bursty",
    f"""WITH {K_SQL}, d AS (SELECT count(*) AS m, min(line_no) AS lo, max(line_no) AS hi FROM l),
p AS (SELECT template_id, (line_no - lo) * 50 // (hi - lo + 1) AS s, count(*) AS n, min(line_no) AS f FROM l, d GROUP BY 1, 2),
t AS (SELECT template_id, CAST(sum(n) AS BIGINT) AS cnt, max(n) AS peak, min(f) AS first_line FROM p GROUP BY 1),
r AS (SELECT template_id, cnt, first_line, list_filter([CASE WHEN cnt <= greatest(m // 1000, 1) THEN 'rare' END, CASE WHEN first_line - lo >= (hi - lo + 1) * 9 // 10 THEN 'first_seen_late' END, CASE WHEN cnt >= 10 AND peak * 2 >= cnt THEN 'bursty' END], lambda x: x IS NOT NULL) AS reasons FROM t, d)
SELECT template_id, cnt, first_line, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0 ORDER BY len(reasons) DESC, cnt, template_id LIMIT 50""",
)
def rare_late_bursty(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), millis(F.col("ts")).alias("ts_ms"), F.col("user_id").cast("int").alias("template_id"))
    return analysis.anomalies(e).withColumn("reasons", F.concat_ws(",", "reasons"))


def samples_sql(ordinals: str) -> str:
    return f"WITH {E_SQL}, r AS (SELECT line_no, ts_ms, row_number() OVER (ORDER BY line_no) - 1 AS o, count(*) OVER () AS n FROM l WHERE template_id = 4) SELECT line_no, ts_ms FROM r WHERE {ordinals}"


@register("samples_first", samples_sql("o < 5"))
def samples_first(spark, sf_dir):
    return analysis.template_samples(event_lines(spark, sf_dir), 4, 5, "first").select("line_no", "ts_ms")


@register("samples_even", samples_sql("list_contains(list_transform(range(7), lambda k: k * (n - 1) // 6), o)"))
def samples_even(spark, sf_dir):
    return analysis.template_samples(event_lines(spark, sf_dir), 4, 7, "even").select("line_no", "ts_ms")


@register("samples_random")
def samples_random(spark, sf_dir):
    return analysis.template_samples(event_lines(spark, sf_dir), 4, 6).select("line_no", "ts_ms")


# ---- order of lines ----


@register("locf_ts", f"WITH {E_SQL} SELECT line_no, last_value(CASE WHEN line_no % 3 = 1 THEN ts_ms END IGNORE NULLS) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS ts_ms FROM l")
def locf_ts(spark, sf_dir):
    lines = event_lines(spark, sf_dir).select(F.lit("e").alias("doc_id"), "line_no", F.when(F.col("line_no") % 3 == 1, F.col("ts_ms")).alias("ts_raw_ms"))
    return sources.forward_filled(lines, chunk=1000).select("line_no", "ts_ms")


RUNS_SQL = f"""{E_SQL}, g AS (SELECT *, CASE WHEN template_id IS DISTINCT FROM lag(template_id) OVER (ORDER BY line_no) THEN 1 ELSE 0 END AS s FROM l),
r AS (SELECT *, sum(s) OVER (ORDER BY line_no) AS run FROM g),
q AS (SELECT run, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS cnt, template_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms FROM r GROUP BY run, template_id)"""


@register("runs", f"WITH {RUNS_SQL} SELECT start_line, end_line, cnt, template_id, start_ms, end_ms FROM q")
def runs(spark, sf_dir):
    return sequence.runs(event_lines(spark, sf_dir)).select("start_line", "end_line", "cnt", "template_id", "start_ms", "end_ms")


@register(
    "sequence_collapsed",
    f"""WITH {RUNS_SQL} SELECT * FROM (SELECT start_line + 1 AS line, end_line + 1 AS end_line, start_ms AS ts_ms, template_id, cnt FROM q WHERE cnt >= 3
UNION ALL SELECT r.line_no + 1, r.line_no + 1, r.ts_ms, r.template_id, 1 FROM r JOIN q USING (run) WHERE q.cnt < 3) ORDER BY line LIMIT 2000""",
)
def sequence_collapsed(spark, sf_dir):
    return sequence.collapsed_sequence(event_lines(spark, sf_dir))


@register("sequence_dense", f"WITH {E_SQL} SELECT line_no + 1 AS line, ts_ms, template_id FROM l ORDER BY line_no LIMIT 1000")
def sequence_dense(spark, sf_dir):
    return sequence.sequence(event_lines(spark, sf_dir), 1000)


@register(
    "context_runs",
    f"""WITH {E_SQL}, h AS (SELECT line_no AS hit FROM l WHERE contains(text, 'user=77')), c AS (SELECT hit, l.* FROM h JOIN l ON l.line_no BETWEEN hit - 4 AND hit + 4),
g AS (SELECT *, CASE WHEN template_id IS DISTINCT FROM lag(template_id) OVER (PARTITION BY hit ORDER BY line_no) THEN 1 ELSE 0 END AS s FROM c),
r AS (SELECT *, sum(s) OVER (PARTITION BY hit ORDER BY line_no) AS run FROM g)
SELECT hit, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS cnt, template_id FROM r GROUP BY hit, run, template_id""",
)
def context_runs(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return sequence.context_runs(lines, search.find(lines, "user=77"), 4)


@register(
    "occurrence_nav",
    f"""WITH {E_SQL}, m AS (SELECT filter_id, line_no, ts_ms FROM (SELECT unnest([{FILTER_CASES}]) AS filter_id, line_no, ts_ms FROM l) WHERE filter_id IS NOT NULL)
SELECT filter_id, line_no, row_number() OVER w AS k, count(*) OVER (PARTITION BY filter_id) AS n, ts_ms - lag(ts_ms) OVER w AS prev_delta_ms, lead(ts_ms) OVER w - ts_ms AS next_delta_ms FROM m WINDOW w AS (PARTITION BY filter_id ORDER BY line_no)""",
)
def occurrence_nav(spark, sf_dir):
    return sequence.occurrences(search.matches(event_lines(spark, sf_dir), FILTERS))


@register("find_next_wrap", f"WITH {E_SQL} SELECT coalesce(min(CASE WHEN line_no > 900 THEN line_no END), min(line_no)) AS line_no FROM l WHERE contains(text, 'error')")
def find_next_wrap(spark, sf_dir):
    return sequence.step(search.find(event_lines(spark, sf_dir), "error"), 900)


@register("find_prev_clamp", f"WITH {E_SQL} SELECT coalesce(max(CASE WHEN line_no < 3 THEN line_no END), min(line_no)) AS line_no FROM l WHERE contains(text, 'error')")
def find_prev_clamp(spark, sf_dir):
    return sequence.step(search.find(event_lines(spark, sf_dir), "error"), 3, forward=False, wrap=False)


@register("nearest_match", f"WITH {E_SQL} SELECT line_no, ts_ms FROM l WHERE contains(text, 'purchase') ORDER BY abs(line_no - 500), line_no LIMIT 1")
def nearest_match(spark, sf_dir):
    return sequence.nearest(search.find(event_lines(spark, sf_dir), "purchase"), 500).select("line_no", "ts_ms")


@register("nearest_in_time", f"WITH {E_SQL} SELECT line_no, ts_ms FROM l WHERE contains(text, 'purchase') ORDER BY abs(ts_ms - {MS1}), ts_ms, line_no LIMIT 1")
def nearest_in_time(spark, sf_dir):
    return sequence.nearest_in_time(search.find(event_lines(spark, sf_dir), "purchase"), MS1).select("line_no", "ts_ms")


@register(
    "asof_nearest",
    f"""WITH {E_SQL}, v AS (SELECT * FROM l WHERE contains(text, 'signup')), p AS (SELECT line_no AS probe_id, ts_ms AS probe_ms FROM l WHERE contains(text, 'error')),
b AS (SELECT p.*, v.ts_ms AS ts, v.line_no AS ln FROM p ASOF LEFT JOIN v ON p.probe_ms >= v.ts_ms), a AS (SELECT p.*, v.ts_ms AS ts, v.line_no AS ln FROM p ASOF LEFT JOIN v ON p.probe_ms <= v.ts_ms),
u AS (SELECT * FROM b UNION ALL SELECT * FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY abs(ts - probe_ms), ts, ln) AS k FROM u WHERE ts IS NOT NULL)
SELECT probe_id, ts AS ts_ms, ln AS line_no FROM r WHERE k = 1""",
)
def asof_nearest(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    probes = search.find(lines, "error").select(F.col("line_no").alias("probe_id"), F.col("ts_ms").alias("probe_ms"))
    return sequence.nearest_each(probes, search.find(lines, "signup"))


@register("approximate_line", f"WITH {E_SQL} SELECT coalesce(min(CASE WHEN ts_ms >= {MS0} THEN line_no END), max(CASE WHEN ts_ms < {MS0} THEN line_no END)) AS line_no FROM l")
def approximate_line(spark, sf_dir):
    return sequence.approximate_line(event_lines(spark, sf_dir), MS0)


PINS = [(1, [40, 41, 42], "late"), (2, [7], "early"), (3, [99_999_999], "gone"), (4, [20, 25], "mid")]


@register(
    "pins_ordered",
    f"""WITH {E_SQL}, p AS (SELECT * FROM (VALUES (1, [40, 41, 42], 'late'), (2, [7], 'early'), (3, [99999999], 'gone'), (4, [20, 25], 'mid')) v(pin_id, ns, comment)),
x AS (SELECT pin_id, CAST(unnest(ns) AS BIGINT) AS line_no FROM p), e AS (SELECT pin_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, min(line_no) AS start_line FROM x JOIN l USING (line_no) GROUP BY 1)
SELECT CAST(p.pin_id AS BIGINT) AS pin_id, start_line, start_ms, end_ms, comment, row_number() OVER w AS place, start_ms - lag(end_ms) OVER w AS since_prev_ms FROM p LEFT JOIN e USING (pin_id) WINDOW w AS (ORDER BY start_ms ASC NULLS LAST, start_line NULLS FIRST, p.pin_id)""",
)
def pins_ordered(spark, sf_dir):
    pinned = spark.createDataFrame(PINS, "pin_id bigint, line_numbers array<bigint>, comment string")
    return sequence.pins(event_lines(spark, sf_dir), pinned)


@register("conversation_runs", "WITH g AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS s FROM conversations), r AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM g) SELECT conv_id, role, min(turn) AS first_turn, count(*) AS cnt FROM r GROUP BY conv_id, run, role")
def conversation_runs(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("s", (~F.col("role").eqNullSafe(F.lag("role").over(w)) | F.lag("turn").over(w).isNull()).cast("int"))
    return c.withColumn("run", F.sum("s").over(w)).groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("cnt")).select("conv_id", "role", "first_turn", "cnt")


# ---- timestamps ----

#: family: (Spark pattern of the line's head, DuckDB check). Lines are written in the family's layout and read back.
LAYOUTS = {
    "iso": ("ISO-8601", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
    "slash": ("YYYY/MM/DD", "yyyy/MM/dd HH:mm:ss.SSS"),
    "us_slash": ("MM/DD/YYYY", "M/d/yyyy HH:mm:ss.SSS"),
    "us_dash": ("MM-DD-YYYY", "M-d-yyyy HH:mm:ss.SSS"),
    "day_dash": ("DD-MM-YYYY", "d-M-yyyy HH:mm:ss.SSS"),
    "day_dot": ("DD.MM.YYYY", "d.M.yyyy HH:mm:ss.SSS"),
    "year_dot": ("YYYY.MM.DD", "yyyy.M.d HH:mm:ss.SSS"),
    "syslog": ("BSD syslog", "MMM d HH:mm:ss"),
    "apache": ("Apache CLF", "'127.0.0.1 - - ['dd/MMM/yyyy:HH:mm:ss '+0000]'"),
    "logcat": ("logcat threadtime", "MM-dd HH:mm:ss.SSS"),
    "glog": ("glog", "'I'MMdd HH:mm:ss.SSS"),
    "iso12": ("ISO-8601 12h AM/PM", "yyyy-MM-dd h:mm:ss.SSS a"),
    "rfc2822": ("RFC 2822", "EEE, d MMM yyyy HH:mm:ss '+0000'"),
}


def _parse_back(name: str):
    family_name, layout = LAYOUTS[name]
    whole_seconds = "SSS" not in layout

    def query(spark, sf_dir):
        from datetime import date

        lines = event_lines(spark, sf_dir)
        line = F.concat(F.date_format(F.timestamp_millis("ts_ms"), layout), F.lit(" x "), F.col("text"))
        ms = timefmt.epoch_ms(F.col("line"), timefmt.BY_NAME[family_name], date(2024, 12, 31))
        return lines.select("line_no", line.alias("line")).select("line_no", ms.alias("ms"))

    register(f"ts_parse_{name}", f"WITH {E_SQL} SELECT line_no, {'ts_ms // 1000 * 1000' if whole_seconds else 'ts_ms'} AS ms FROM l")(query)


for _name in LAYOUTS:
    _parse_back(_name)


@register("ts_parse_epoch", f"WITH {E_SQL} SELECT line_no, CASE WHEN line_no % 2 = 0 THEN ts_ms ELSE ts_ms // 1000 * 1000 END AS ms FROM l")
def ts_parse_epoch(spark, sf_dir):
    head = F.when(F.col("line_no") % 2 == 0, F.col("ts_ms")).otherwise(F.expr("ts_ms div 1000")).cast("string")
    line = F.concat(head, F.lit(" "), F.col("text"))
    return event_lines(spark, sf_dir).select("line_no", timefmt.epoch_ms(line, timefmt.BY_NAME["epoch"]).alias("ms"))


@register("ts_parse_custom", f"WITH {E_SQL} SELECT line_no, ts_ms AS ms FROM l")
def ts_parse_custom(spark, sf_dir):
    custom = timefmt.CustomFormat("own", r"<(?P<day>\d+)\|(?P<month>\d+)\|(?P<year>\d+) (?P<hour>\d+)h(?P<min>\d+)m(?P<sec>\d+)s(?P<ms>\d+)>")
    line = F.concat(F.lit("at "), F.date_format(F.timestamp_millis("ts_ms"), "'<'dd|MM|yyyy HH'h'mm'm'ss's'SSS'>'"), F.lit(" "), F.col("text"))
    return event_lines(spark, sf_dir).select("line_no", custom.column(line).alias("ms"))


@register("time_texts", f"WITH {E_SQL} SELECT line_no, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS time FROM l")
def time_texts(spark, sf_dir):
    return event_lines(spark, sf_dir).select("line_no", timefmt.format_ms_column(F.col("ts_ms")).alias("time"))


@register(
    "durations",
    f"WITH {E_SQL}, g AS (SELECT line_no, ts_ms - lag(ts_ms) OVER (ORDER BY line_no) AS g FROM l) SELECT line_no, 'Δ ' || CASE WHEN g >= 3600000 THEN g // 3600000 || 'h ' || g // 60000 % 60 || 'm' WHEN g >= 60000 THEN g // 60000 || 'm ' || g // 1000 % 60 || 's' WHEN g >= 1000 THEN format('{{:.1f}}', CAST(g AS DOUBLE) / 1000.0::DOUBLE) || 's' ELSE g || 'ms' END AS length FROM g WHERE g IS NOT NULL",
)
def durations(spark, sf_dir):
    seen = analysis.with_previous(event_lines(spark, sf_dir).select("line_no", "ts_ms"), ["ts_ms"]).where("prev_ts_ms is not null")
    return seen.select("line_no", sequence.format_delta_ms(F.col("ts_ms") - F.col("prev_ts_ms")).alias("length"))


# ---- masking, formats, mining ----


def _duck_class(token: str) -> str:
    cases = "".join(f" WHEN regexp_matches({token}, '{duck(p)}') THEN '{name}'" for p, name in DUCK_SHAPES)
    return f"CASE{cases} END"


def duck(pattern: str) -> str:
    return pattern.replace("'", "''")


#: The shapes without look-ahead, which DuckDB's regular expressions lack.
DUCK_SHAPES = (
    (r"^.*://.*$", "<URL>"),
    (r"^[^@]+@(?:.{3,}\..*|..\..*|.\..+|\..{2,})$", "<EMAIL>"),
    (masking.JSON, "<JSON>"),
    (masking.UUID, "<UUID>"),
    (masking.CLOCK, "<TIME>"),
    (masking.IPV4, "<IP>"),
)


@register(
    "mask_class_counts",
    f"""WITH {D_SQL}, t AS (SELECT unnest(regexp_split_to_array(text, '[\\x09-\\x0D\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+')) AS t FROM l)
SELECT cls, count(*) AS cnt FROM (SELECT {_duck_class('t')} AS cls FROM t WHERE t <> '') WHERE cls IS NOT NULL GROUP BY 1""",
)
def mask_class_counts(spark, sf_dir):
    words = document_lines(spark, sf_dir).select(F.explode(masking.tokens_of(F.col("text"))).alias("t"))
    tokens = words.groupBy("t").agg(F.count(F.lit(1)).alias("n"))  # each distinct token is matched once
    names = sorted({n for _, n in DUCK_SHAPES})
    cls = masking.token_class(F.col("t"), masking.MaskConfig(paths=False, nums=False, hex=False))
    shown = tokens.select(F.when(~F.col("t").rlike(masking.DURATION), cls).otherwise(F.lit(None)).alias("cls"), "n")
    return shown.where(F.col("cls").isin(names)).groupBy("cls").agg(F.sum("n").alias("cnt"))


@register("mask_numbers", f"WITH {E_SQL} SELECT regexp_replace(regexp_replace(text, 'user=[0-9]+', 'user=<NUM>'), '[0-9]+\\}}', '<NUM>}}') AS masked, count(*) AS cnt FROM l GROUP BY 1")
def mask_numbers(spark, sf_dir):
    return event_lines(spark, sf_dir).select(masking.masked(F.col("text")).alias("masked")).groupBy("masked").agg(F.count(F.lit(1)).alias("cnt"))


WORDS_SQL = r"unnest(regexp_split_to_array(text, '[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS t"
MORE_CLASSES_SQL = r"""WHEN regexp_matches(t, '^[0-9A-Fa-f:]{6,}$') AND length(t) - length(replace(t, ':', '')) >= 2 THEN '<IPV6>'
  WHEN regexp_matches(t, '^/.*/.*$') OR (regexp_matches(t, '^/.{3,}$') AND contains(t, '.')) OR regexp_matches(t, '^\x5C\x5C.{3,}$') OR regexp_matches(t, '^[A-Za-z]:\x5C.+$') THEN '<PATH>'
  WHEN regexp_matches(t, '^[0-9.mshd]+$') AND regexp_matches(t, '[0-9.]') AND regexp_matches(t, '[mshd]') THEN '<TIME>'
  WHEN regexp_matches(t, '^[+-]?[0-9]*[.]?[0-9]*$') AND regexp_matches(t, '[0-9]') THEN '<NUM>'
  WHEN regexp_matches(t, '^[0-9A-Fa-f]{8,64}$') AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Fa-f]') THEN '<HEX>'"""


@register(
    "mask_token_classes",
    f"""WITH {D_SQL}, s AS (SELECT {WORDS_SQL} FROM l), w AS (SELECT t, {_duck_class('t')} AS whole FROM s WHERE t <> ''),
c AS (SELECT t, CASE WHEN whole IS NOT NULL THEN whole {MORE_CLASSES_SQL} END AS cls FROM w)
SELECT cls, count(*) AS cnt, count(DISTINCT t) AS tokens FROM c WHERE cls IS NOT NULL GROUP BY 1""",
)
def mask_token_classes(spark, sf_dir):
    """All classes of whole tokens, paths, durations, numbers and hexadecimal ones included."""
    words = document_lines(spark, sf_dir).select(F.explode(masking.tokens_of(F.col("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    classed = words.select(masking.token_class(F.col("t")).alias("cls"), "n").where("cls is not null")
    return classed.groupBy("cls").agg(F.sum("n").alias("cnt"), F.count(F.lit(1)).alias("tokens"))


@register(
    "display_texts",
    f"""WITH {D_SQL} SELECT doc_id, line_no, CASE WHEN strlen(text) <= 60 THEN text ELSE substr(text, 1, list_max([k FOR k IN range(15, 61) IF strlen(substr(text, 1, CAST(k AS INTEGER))) <= 60])) || '  …[' || strlen(text) || ' bytes total, truncated]' END AS shown FROM l""",
)
def display_texts(spark, sf_dir):
    return document_lines(spark, sf_dir).select("doc_id", "line_no", search.display_text(F.col("text"), 60).alias("shown"))


@register("masked_line_counts")
def masked_line_counts(spark, sf_dir):
    masked = document_lines(spark, sf_dir).select(masking.masked_lines(F.col("text")).alias("content"))
    return masked.groupBy("content").agg(F.count(F.lit(1)).alias("cnt"))


@register("json_schema_content", "SELECT 'k=<NUM>' AS content, count(*) AS cnt FROM events WHERE json_keys(props) = ['k'] GROUP BY 1")
def json_schema_content(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.col("props").alias("text"))
    return formats.normalized(lines, formats.FORMATS[0]).groupBy("content").agg(F.count(F.lit(1)).alias("cnt"))


@register("format_hits", "SELECT count(*) FILTER (WHERE regexp_matches(trim(props), '^\\{.*\\}$')) AS json, count(*) FILTER (WHERE props LIKE 'CEF:%') AS cef, count(*) AS n FROM events")
def format_hits(spark, sf_dir):
    text = F.col("props")
    hits = [F.count_if(f.matches(text)).alias(f.name) for f in formats.FORMATS[:2]]
    return table(spark, sf_dir, "events").agg(*hits, F.count(F.lit(1)).alias("n"))


@register("header_position_stats", f"WITH {E_SQL}, t AS (SELECT string_split(text, ' ') AS w FROM l WHERE line_no < 200), p AS (SELECT unnest(range(1, len(w) + 1)) AS i, w FROM t) SELECT CAST(i - 1 AS INTEGER) AS pos, count(*) AS present, count(DISTINCT w[i]) AS distinct_tokens FROM p GROUP BY 1")
def header_position_stats(spark, sf_dir):
    head = event_lines(spark, sf_dir).where("line_no < 200")
    tokens = head.select(F.posexplode(masking.tokens_of(F.col("text"))).alias("pos", "token"))
    return tokens.groupBy("pos").agg(F.count(F.lit(1)).alias("present"), F.count_distinct("token").alias("distinct_tokens"))


def _mined_events(spark, sf_dir):
    lines = event_lines(spark, sf_dir).select(F.lit("e").alias("doc_id"), "line_no", "ts_ms", "text", masking.masked_lines(F.col("text")).alias("content"))
    return mining.mine(lines)


@register("drain_template_counts", f"WITH {E_SQL} SELECT split_part(text, ' ', 1) || ' user=<NUM> {{\"k\": <NUM>}}' AS pattern, count(*) AS count, min(line_no) AS example_line FROM l GROUP BY 1")
def drain_template_counts(spark, sf_dir):
    return _mined_events(spark, sf_dir)[1].where("template_id > 0").select("pattern", "count", "example_line")


@register("drain_template_ids", f"WITH {E_SQL}, f AS (SELECT template_id, CAST(row_number() OVER (ORDER BY min(line_no)) AS INTEGER) AS tid FROM l GROUP BY 1) SELECT line_no, tid AS template_id FROM l JOIN f USING (template_id)")
def drain_template_ids(spark, sf_dir):
    return _mined_events(spark, sf_dir)[0].select("line_no", "template_id")


@register("drain_documents")
def drain_documents(spark, sf_dir):
    """Templates of each document, of whole lines and without limits of keys or templates."""
    lines = document_lines(spark, sf_dir).select("doc_id", "line_no", masking.masked_lines(F.col("text")).alias("content"))
    return mining.templates_of(lines)


WORDLESS = "[^\\s\\-\\[\\]{{}}(),\"'']"


@register(
    "keyword_at",
    f"WITH {E_SQL}, p AS (SELECT line_no, text, CAST(line_no * 7 % (length(text) + 2) AS INTEGER) AS p FROM l) SELECT line_no, CASE WHEN regexp_matches(substr(text, p + 1, 1), '{WORDLESS}') THEN regexp_extract(substr(text, 1, p), '{WORDLESS}*$') || regexp_extract(substr(text, p + 1), '^{WORDLESS}+') END AS word FROM p".replace("{{}}", "{}").replace("\\\\", "\\"),
)
def keyword_at(spark, sf_dir):
    at = (F.col("line_no") * 7 % (F.length("text") + 2)).cast("int")
    return event_lines(spark, sf_dir).select("line_no", sequence.keyword_at(F.col("text"), at).alias("word"))


@register("bench_log_levels", "SELECT ['INFO', 'DEBUG', 'WARN', 'ERROR'][(i % 97 // 24) % 4 + 1] AS level, count(*) AS cnt FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1")
def bench_log_levels(spark, sf_dir):
    """Levels of a synthetic log of as many lines as there are events."""
    return sources.bench_log(spark, table(spark, sf_dir, "events").count()).select(F.split("text", " ")[1].alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("cnt"))


from . import files, indexed  # noqa: E402, F401  (they register their queries)
