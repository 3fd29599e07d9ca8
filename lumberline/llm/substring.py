"""Removal of word sequences that an earlier document already has.

Every window of ``width`` words is hashed (Rabin-Karp: a polynomial of word hashes, rolled along the document). Windows
that also start in a document with a smaller id are repeats; overlapping repeats merge into maximal intervals, which are
cut out.

At scale there are as many windows as words, so windows are not rows. Documents are dealt into groups by ranges of their
id. Each group sorts its distinct window hashes and sends them, packed, to reducers by ranges of the hash. As groups are
ordered by id, a reducer needs no ids to say which hashes of a group were seen in an earlier group: it answers with one
bit for each hash. Inside a group the smallest id of each hash is known locally.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, spool

WIDTH = 13
#: Text that a group of documents holds, about; a group is one task's memory.
GROUP_BYTES = 12 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers never vanish modulo 2**64


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """The 64-bit hash of each window of ``width`` words."""
    n = len(words) - width + 1
    if n < 1:
        return np.array([], np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out *= BASE
        out += h[k : n + k]
    out ^= out >> np.uint64(29)  # spread over the whole range: reducers are ranges of it
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def intervals(repeated: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of words covered by the repeated windows (their starts, sorted)."""
    if not len(repeated):
        return []
    breaks = np.flatnonzero(np.diff(repeated) > width)
    starts = repeated[np.r_[0, breaks + 1]]
    ends = repeated[np.r_[breaks, len(repeated) - 1]] + width
    return list(zip(starts.tolist(), ends.tolist()))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, in planes of bytes: the high planes are zeros and compress away."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


class Group:
    """The windows of one group of documents: sorted distinct hashes, and for each window its place among them."""

    def __init__(self, ids: list[int], texts: list[str | None], width: int):
        self.order = sorted(range(len(ids)), key=ids.__getitem__)
        hashes = [window_hashes(split_words(texts[i]), width) for i in self.order]
        counts = [len(h) for h in hashes]
        every = np.concatenate(hashes) if hashes else np.array([], np.uint64)
        owner = np.repeat(np.array([ids[i] for i in self.order], np.int64), counts)
        self.ends = np.cumsum(counts).tolist()
        self.hashes, first, self.place = np.unique(every, return_index=True, return_inverse=True)
        self.earlier_here = owner > owner[first][self.place] if len(every) else np.array([], bool)

    def cuts(self, ranges: int) -> np.ndarray:
        """Where each range of hashes starts and ends among the sorted ones."""
        edges = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)
        return np.r_[0, np.searchsorted(self.hashes, edges), len(self.hashes)]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, n_words, n_removed, intervals, kept): one row for each row of ``df``; ``kept`` joins the kept words by one
    space, ``intervals`` are the [start, end) word positions cut out.

    Null and empty texts have no words. Rows with a null id stand outside the order of ids: they lose nothing and take
    nothing from others. Rows with one id never take from each other. Windows are judged on the input alone. Other
    columns are not looked at; an empty table gives an empty result. Texts of any length are read whole; the group that
    holds a text must fit a task's memory.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    numbered = rows.where("id is not null")
    total = numbered.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / group_bytes), n_partitions(spark))
    # bounds at equal counts of rows; approximate bounds are as right as exact ones. Ids that meet a bound share a group
    at = [i / groups for i in range(1, groups)]
    bounds = sorted(set(numbered.agg(F.percentile_approx("id", at, 100 * groups)).first()[0] or [])) if at else []
    edges = np.array(bounds, np.int64)
    n_groups = len(edges) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = np.searchsorted(edges, b.column(0).to_numpy(), side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(g), *b.columns], ["g", "id", "text"])

    dealt = numbered.mapInArrow(deal, "g int, id bigint, text string")
    ranges = n_groups

    def load(table: pa.Table) -> Group:
        return Group(table.column("id").to_pylist(), table.column("text").to_pylist(), width)

    def send(table: pa.Table) -> pa.Table:
        group = load(table)
        cuts = group.cuts(ranges)
        full = [r for r in range(ranges) if cuts[r] < cuts[r + 1]]
        g = table.column("g")[0].as_py()
        return pa.table({"g": pa.array([g] * len(full), pa.int32()), "r": pa.array(full, pa.int32()), "hashes": pa.array([pack_sorted(group.hashes[cuts[r] : cuts[r + 1]]) for r in full], pa.binary())})

    def seen_before(table: pa.Table) -> pa.Table:
        r = table.column("r")[0].as_py()
        parts = sorted(zip(table.column("g").to_pylist(), table.column("hashes")), key=lambda x: x[0])
        values = [unpack_sorted(x.as_py()) for _, x in parts]
        every = np.concatenate(values)
        order = np.argsort(every, kind="stable")  # groups stay in order among equal hashes
        ordered = every[order]
        again = np.zeros(len(every), bool)
        again[order[1:]] = ordered[1:] == ordered[:-1]
        out, at = [], 0
        for v in values:
            out.append(np.packbits(again[at : at + len(v)]).tobytes())
            at += len(v)
        return pa.table({"g": pa.array([g for g, _ in parts], pa.int32()), "r": pa.array([r] * len(parts), pa.int32()), "seen": pa.array(out, pa.binary())})

    def cut(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = docs.column("id").to_pylist(), docs.column("text").to_pylist()
        group = Group(ids, texts, width)
        cuts = group.cuts(ranges)
        repeated = np.zeros(len(group.hashes), bool)
        for r, bits in zip(answers.column("r").to_pylist(), answers.column("seen").to_pylist()):
            n = int(cuts[r + 1] - cuts[r])
            repeated[cuts[r] : cuts[r + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).view(bool)
        drop = repeated[group.place] | group.earlier_here if len(group.place) else group.earlier_here
        out = []
        for n, i in enumerate(group.order):
            first = group.ends[n - 1] if n else 0
            out.append(result(ids[i], texts[i], np.flatnonzero(drop[first : group.ends[n]]), width))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ARROW)], names=[x.split()[0] for x in DDL.split(", ", 4)])

    sent = dealt.groupBy("g").applyInArrow(send, "g int, r int, hashes binary")
    answers = sent.groupBy("r").applyInArrow(seen_before, "g int, r int, seen binary")
    known = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(cut, DDL)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [result(None, x.as_py(), np.array([], np.int64), width) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, ARROW)], names=[x.split()[0] for x in DDL.split(", ", 4)])

    return known.union(rows.where("id is null").mapInArrow(untouched, DDL))


DDL = "id bigint, n_words bigint, n_removed bigint, intervals array<struct<start:bigint,end:bigint>>, kept string"
ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())


def result(doc_id: int | None, text: str | None, repeated: np.ndarray, width: int) -> tuple:
    words = split_words(text)
    spans = intervals(repeated, width)
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return doc_id, len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans], b" ".join(kept).decode("utf-8", "surrogatepass")


def kept_digest(kept: str) -> str:
    return hashlib.sha256(kept.encode("utf-8")).hexdigest()


def op3_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT rid, doc_id, unnest(range(1, CAST(len(w) AS BIGINT) - {WIDTH - 2})) AS i, w FROM d WHERE len(w) >= {WIDTH}),
h AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + {WIDTH - 1}], ' ')) AS h FROM t),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
c AS (SELECT DISTINCT rid, unnest(range(i, i + {WIDTH})) AS p FROM h JOIN m USING (h) WHERE least < doc_id),
g AS (SELECT rid, list(p) AS gone FROM c GROUP BY rid),
k AS (SELECT d.*, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN g USING (rid))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
