"""Removal of boilerplate lines by their frequency within a site.

For each host, the share of its pages that contain a line; lines whose share exceeds a ratio are dropped from all pages
of that host. Everything is DataFrame work: pages are turned into arrays of 128-bit line keys, counted by host and line
with partial sums, and the few lines over the ratio go back to the pages by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spool

#: So many boilerplate lines at most are broadcast (some 40 bytes each); with more, pages and hosts meet in a shuffled
#: join whose hot hosts adaptive execution splits.
BROADCAST_LINES = 200_000


#: All that counts as white space around a line, if spaces alone are not to be.
BLANKS = " \t\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(line: Column, blanks: str = " ") -> Column:
    return F.trim(line) if blanks == " " else F.trim(line, F.lit(blanks))


def line_key(line: Column, blanks: str = " ") -> Column:
    """Two 64-bit hashes of the line without outer ``blanks``, as one string."""
    line = trimmed(line, blanks)
    return F.concat_ws(":", F.xxhash64(line).cast("string"), F.xxhash64(F.lit(1), line).cast("string"))


def page_lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r", ""), "\n", -1)


def line_dedup(
    df: DataFrame,
    id_col: str,
    host_col: str,
    text_col: str,
    max_ratio: float = 0.1,
    min_pages: int = 5,
    distinct_pages: bool = False,
    broadcast_lines: int = BROADCAST_LINES,
    blanks: str = " ",
) -> DataFrame:
    """``df`` with ``text_col`` reduced to its kept lines, and ``n_lines``, ``n_dropped``.

    A line is dropped from the pages of a host if more than ``max_ratio`` of the host's pages, and ``min_pages`` of them
    at least, contain it; on hosts of few pages ``min_pages`` decides. Lines are compared without outer ``blanks`` (each
    character of it; ``BLANKS`` has all white space); blank lines are neither counted nor dropped.
    With ``distinct_pages`` pages of one host with the same text count as one page, so that a page copied many times
    over is not taken for boilerplate. Rows without a host or text are returned unchanged (``n_dropped`` 0, ``n_lines``
    0 for a null text). Repeated ids need no care: rows never meet by id. Columns named ``n_lines`` or ``n_dropped`` are
    replaced.
    """
    df = df.drop("n_lines", "n_dropped")
    host, text = F.col(host_col), F.col(text_col)
    filled = F.filter(page_lines(text), lambda x: trimmed(x, blanks) != "")
    pages = df.where(host.isNotNull() & text.isNotNull()).select(
        host.alias("__host"), F.xxhash64(text).alias("__p1"), F.xxhash64(F.lit(1), text).alias("__p2"), F.array_distinct(F.transform(filled, lambda x: line_key(x, blanks))).alias("__keys")
    )
    if distinct_pages:
        pages = pages.groupBy("__host", "__p1", "__p2").agg(F.first("__keys").alias("__keys"))
    totals = pages.groupBy("__host").agg(F.count(F.lit(1)).alias("__pages"))
    counts = pages.select("__host", F.explode("__keys").alias("__key")).groupBy("__host", "__key").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.where(F.col("__n") >= min_pages)
    over = counts.join(totals, "__host").where(F.col("__n") > max_ratio * F.col("__pages"))
    # fewer than (lines of a page) / max_ratio for each host
    by_host = spool(over.groupBy("__host").agg(F.collect_list("__key").alias("__over")))
    n_over = by_host.agg(F.coalesce(F.sum(F.size("__over")), F.lit(0))).first()[0]
    if n_over <= broadcast_lines:
        by_host = F.broadcast(by_host)
    joined = df.join(by_host, host == F.col("__host"), "left")
    lines = page_lines(text)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__over"), line_key(x, blanks)) | (trimmed(x, blanks) == ""))
    untouched = F.col("__over").isNull() | text.isNull()
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    out = joined.withColumn("__kept", F.when(~untouched, kept)).withColumn("n_lines", n_lines)
    out = out.withColumn("n_dropped", F.when(untouched, F.lit(0)).otherwise(F.col("n_lines") - F.size("__kept")).cast("long"))
    new_text = F.when(F.col("n_dropped") > 0, F.array_join("__kept", "\n")).otherwise(text)
    return out.select(*[new_text.alias(c) if c == text_col else F.col(f"`{c.replace('`', '``')}`") for c in df.columns], "n_lines", "n_dropped")


#: Tags end a line of a page as line feeds do.
TAG = "<[^>]*>"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.lower(F.regexp_extract("url", HOST, 1))
    shown = pages.select("page_id", F.when(host != "", host).alias("host"), F.regexp_replace("html", TAG, "\n").alias("text"))
    return line_dedup(shown, "page_id", "host", "text").select("page_id", "host", "n_lines", "n_dropped", "text")


OP10_SQL = f"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, regexp_replace(html, '{TAG}', chr(10), 'g') AS text FROM pages),
s AS (SELECT p.*, string_split(replace(text, chr(13), ''), chr(10)) AS lines, row_number() OVER () AS rid FROM p),
u AS (SELECT DISTINCT rid, host, trim(x, ' ') AS line FROM (SELECT rid, host, unnest(lines) AS x FROM s WHERE host IS NOT NULL) WHERE trim(x, ' ') <> ''),
t AS (SELECT host, count(*) AS pages FROM p WHERE host IS NOT NULL AND text IS NOT NULL GROUP BY host),
o AS (SELECT u.host, line FROM u JOIN t USING (host) GROUP BY u.host, line, pages HAVING count(*) >= 5 AND count(*) > CAST(0.1 AS DOUBLE) * pages),
g AS (SELECT host, list(line) AS gone FROM o GROUP BY host),
k AS (SELECT s.*, CASE WHEN gone IS NULL OR lines IS NULL THEN lines ELSE list_filter(lines, lambda x: trim(x, ' ') = '' OR NOT list_contains(gone, trim(x, ' '))) END AS kept FROM s LEFT JOIN g USING (host))
SELECT page_id, host, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
  CASE WHEN len(kept) < len(lines) THEN array_to_string(kept, chr(10)) ELSE text END AS text FROM k
"""
