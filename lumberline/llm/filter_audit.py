"""How filters interact: what each of them removes in every order in which they can be applied.

A document's failures are a mask of one bit a filter. For each mask and each order a table of 32 by 120 entries holds the
step at which the first failing filter stands; so documents are counted by part, mask and labels, each count is spread over
the orders by that table, and everything reported follows from the removals by part, order, step and labels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read

FILTERS = "ABCDE"
ORDERS = list(permutations(range(len(FILTERS))))
NAMES = ["".join(FILTERS[f] for f in order) for order in ORDERS]
STEPS, CLASSES = len(FILTERS), 4
#: The step (from 0) at which a document with a mask goes, by mask and order; STEPS where it stays.
FIRST_FAILURE = np.array([[next((s for s, f in enumerate(order) if mask >> f & 1), STEPS) for order in ORDERS] for mask in range(1 << STEPS)], np.int64)
#: Parts whose arrays a worker holds at a time (23 kB each).
PARTS_AT_ONCE = 256

FEW_WORDS, SIGNS = 200, b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
DUPLICATE = 1 << FILTERS.index("E")


def failures(text: str | None) -> int:
    """The bits of the filters that look at one text alone (A to D); null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    few = len(words) < FEW_WORDS
    repeated = 100 * len(set(words)) < 50 * len(words)
    shouted = 100 * (len(raw) - len(raw.translate(None, UPPER))) > 2 * len(text)
    signs = len(raw) > len(raw.translate(None, SIGNS))
    return few | repeated << 1 | shouted << 2 | signs << 3


def with_failures(docs: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, part, mask, digest) of each row: the failures of its whole text, and the text's SHA-256, by which equal texts are
    found. A null part is the empty string, a null text is empty; rows are kept with null and repeated ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks, digests = [], []
            for x in b.column(2):
                text = x.as_py() or ""
                masks.append(failures(text))
                digests.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, part string, mask int, digest binary")


def counted_failures(judged: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, class, n): documents by part, failures and labels, where a text that a smaller id has too also fails E.

    ``labels`` has ``id_col``, ``quality`` and ``toxic``; a document's class is 1 if its quality is 1, plus 2 if it is toxic
    (by any of its labels). Nothing is listed by group of equal texts: rows of a text are summed by part and labels first,
    with the least id and its number, so a text of a third of all rows is a few rows for each part. Rows that share the least
    id don't fail E, and rows without an id never do.
    """
    marks = labels.groupBy(F.col(id_col).alias("id")).agg((F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("int") + 2 * F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("int")).alias("class"))
    rows = judged.join(marks, "id", "left").withColumn("class", F.coalesce("class", F.lit(0)))
    kinds = ["digest", "part", "mask", "class"]
    by_id = rows.groupBy("id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("id").isNotNull()
    by_text = by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nameless"), F.min(F.when(known, F.struct("id", "n"))).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    own = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = by_text.withColumn("least", least).withColumn("own", own)
    split = split.select("part", "class", F.inline(F.array(F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + DUPLICATE).alias("mask"), (F.col("n") - F.col("own")).alias("n")))))
    return split.where("n > 0").groupBy("part", "mask", "class").agg(F.sum("n").alias("n"))


def removals(counted: DataFrame) -> DataFrame:
    """(part, removals): partial arrays of documents by order, step (the last: kept) and class, one for each part and batch.

    A part has at most 32 masks times 4 classes as rows, so there are at most 128 partial arrays of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(ORDERS) * (STEPS + 1) * CLASSES
        for b in batches:
            coded = b.column(0).dictionary_encode()
            part = coded.indices.to_numpy(zero_copy_only=False)
            mask, label, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for lo in range(0, len(coded.dictionary), PARTS_AT_ONCE):
                here = (part >= lo) & (part < lo + PARTS_AT_ONCE)
                step = FIRST_FAILURE[mask[here]]
                at = (((part[here, None] - lo) * len(ORDERS) + np.arange(len(ORDERS))) * (STEPS + 1) + step) * CLASSES + label[here, None]
                parts = coded.dictionary.slice(lo, PARTS_AT_ONCE)
                sums = np.bincount(at.ravel(), np.repeat(n[here].astype(float), len(ORDERS)), len(parts) * size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([parts, pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * size, pa.int32()), pa.array(sums))], ["part", "removals"])

    return counted.select("part", "mask", "class", "n").mapInArrow(run, "part string, removals array<bigint>")


def interactions(partial: DataFrame) -> DataFrame:
    """The report of each part: a row for every order and step, from the sum of the part's arrays."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        flat = pc.list_flatten(table.column("removals")).combine_chunks().to_numpy(zero_copy_only=False)
        found = flat.reshape(table.num_rows, len(ORDERS), STEPS + 1, CLASSES).sum(axis=0)
        gone = found[:, :STEPS].sum(axis=2)
        total = int(found[0].sum())
        order = np.array(ORDERS)
        first, last, shapley = (np.zeros(STEPS, np.int64) for _ in range(3))
        first[order[:, 0]], last[order[:, -1]] = gone[:, 0], gone[:, -1]  # all that fail a filter, and those that fail only it
        np.add.at(shapley, order, gone)
        columns = {
            "kept": total - gone.cumsum(axis=1),
            "removed": gone,
            "redundant": first[order] - gone,
            "unique_fails": last[order],
            "good_lost": found[:, :STEPS, [1, 3]].sum(axis=2),
            "toxic_lost": found[:, :STEPS, [2, 3]].sum(axis=2),
            "shapley": shapley[order],
        }
        names = {"part": pa.array([key[0].as_py()] * gone.size, pa.string()), "filter_order": pa.array([x for x in NAMES for _ in range(STEPS)]), "step": pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))}
        return pa.table(names | {k: pa.array(v.ravel(), pa.int64()) for k, v in columns.items()})

    return partial.groupBy("part").applyInArrow(run, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """What the five filters remove from each part of ``docs`` in all 120 orders; one row for each part, order and step.

    A: under 200 words; B: under half of the words distinct; C: over 2 % of the characters are A-Z; D: a sign of ``#$%&*|``;
    E: the text of a smaller id. An empty table gives no rows; documents without labels count as neither good nor toxic; other
    columns of ``docs`` are not read.
    """
    return interactions(removals(counted_failures(with_failures(docs, id_col, part_col, text_col), labels, id_col)))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
m AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(w.doc_id > least, false) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN m ON w.doc_id = m.doc_id),
n AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step),
g AS (
  SELECT n.*, filter_order, step, substr(filter_order, step, 1) AS x,
    fails <> '' AND contains(fails, substr(filter_order, step, 1)) AS fails_it,
    fails <> '' AND regexp_matches(substr(filter_order, 1, step - 1), '[' || CASE WHEN fails = '' THEN ' ' ELSE fails END || ']') AS gone
  FROM n, o, s),
r AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails_it AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND fails_it AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM g GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM r
"""
