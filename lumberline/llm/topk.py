"""Exact top-k by inner product, by distributed selection on score histograms.

Queries and candidates are cut into blocks. In each round every (query block, candidate block) pair is scored as one
matrix product and each query's scores are counted into the bins of its current range; the bins, summed over all
candidate blocks, tell which bin holds the kth best score, and that bin is the next range. When the range is one score
wide the kth value is known exactly. A last pass keeps what lies above it, and of the ties only the k smallest ids of
each block, from which the final ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, spool

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
BINS = 2048
BLOCKS = "dim int, ids binary, vectors binary"
#: Blocks that a part of the candidates has, about; a task holds one part.
BLOCKS_PER_PART = 16


def scaled(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component as long; rows that take no part are gone."""
    v = F.col(vector_col)
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return df.where(F.col(id_col).isNotNull()).where(finite).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors of equal length gathered into binary blocks of up to ``size``, inside partitions."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            ids = np.array([i for i, _ in rows], "<i8").tobytes()
            data = np.array([v for _, v in rows], "<i8").reshape(len(rows), dim).tobytes()
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": pa.array([ids], pa.binary()), "vectors": pa.array([data], pa.binary())})

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            for i in range(len(ids)):
                dim = int(ends[i + 1] - ends[i])
                held.setdefault(dim, []).append((int(ids[i]), flat[ends[i] : ends[i + 1]]))
                if len(held[dim]) == size:
                    yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    return vectors.select("id", "v").mapInArrow(gather, BLOCKS)


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where every sum stays below 2**53, else in 64-bit integers."""
    peak = max(np.abs(queries).max(initial=0), np.abs(candidates).max(initial=0))
    if float(peak) ** 2 * queries.shape[1] < 2**53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    return queries @ candidates.T


def _pair(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dim = int(row.dim)
    q_ids, c_ids = np.frombuffer(row.q_ids, "<i8"), np.frombuffer(row.ids, "<i8")
    q = np.frombuffer(row.q_vectors, "<i8").reshape(len(q_ids), dim)
    c = np.frombuffer(row.vectors, "<i8").reshape(len(c_ids), dim)
    return q_ids, c_ids, products(q, c)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, bins: int = BINS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` best candidates, ties to the smaller id, itself left out.

    Vectors that are null, or hold null or non-finite components, take no part; nor do rows with a null id. Only vectors
    of equal length are compared. Repeated rows are candidates of their own; a query id that occurs several times is asked
    once, with its smallest vector. Other columns are not looked at. Empty
    tables give an empty result; products that could leave 62 bits raise a ``ValueError``. Queries are not broadcast: their
    blocks are sent once to each part of the candidates (some 16 blocks, whatever the table's size), and a block pair is
    scored at a time.
    """
    spark = candidates.sparkSession
    c_blocks = spool(blocks(scaled(candidates, id_col, vector_col, scale), CANDIDATE_BLOCK))
    parts = max(n_partitions(spark), -(-c_blocks.select("dim").count() // BLOCKS_PER_PART))
    c_blocks = c_blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    q_blocks = spool(blocks(scaled(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")), QUERY_BLOCK))

    def scored(state: DataFrame | None) -> DataFrame:
        """One row for each pair of blocks, with the query block's current ranges."""
        q = q_blocks.select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")) if state is None else state
        sent = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return sent.join(c_blocks.hint("shuffle_hash"), ["part", "dim"])

    # The ranges of the queries of a block travel with the block: lowest score, bin width, and how many scores are
    # still wanted inside the range.
    def widest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"p": [int(np.abs(np.frombuffer(v, "<i8")).max(initial=0)) for v in pdf["vectors"]], "dim": pdf["dim"]})

    peaks = c_blocks.select("dim", "vectors").union(q_blocks.select("dim", "vectors")).mapInPandas(widest, "p bigint, dim int")
    peak, dim = peaks.agg(F.coalesce(F.max("p"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(0))).first()
    bound = int(peak) ** 2 * int(dim)
    if bound >= 2**62:
        raise ValueError("inner products don't fit 64-bit integers: take a smaller scale")
    width = 1
    while width * bins < 2 * bound + 1:
        width *= bins

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = [len(x) // 8 for x in pdf["q_ids"]]
            yield pdf.assign(low=[np.full(m, -bound, "<i8").tobytes() for m in n], want=[np.full(m, k, "<i8").tobytes() for m in n])

    state_ddl = "dim int, q_ids binary, q_vectors binary, low binary, want binary"
    state = q_blocks.select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).mapInPandas(start, state_ddl)

    while True:
        def histogram(batches: Iterator[pd.DataFrame], width: int = width) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    q_ids, c_ids, scores = _pair(row)
                    at = (scores - np.frombuffer(row.low, "<i8")[:, None]) // width
                    at = np.where((at < 0) | (at >= bins) | (q_ids[:, None] == c_ids), bins, at)  # the last bin is for scores outside
                    flat = at + np.arange(len(q_ids))[:, None] * (bins + 1)
                    counts = np.bincount(flat.ravel(), minlength=len(q_ids) * (bins + 1)).reshape(len(q_ids), bins + 1)[:, :bins]
                    i, b = np.nonzero(counts)
                    yield pd.DataFrame({"id": q_ids[i], "bin": b.astype(np.int32), "n": counts[i, b]})

        counted = scored(state).mapInPandas(histogram, "id bigint, bin int, n bigint").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("id").orderBy(F.desc("bin"))
        reach = counted.withColumn("m", F.sum("n").over(above))
        # Each query block takes up the bin that its own queries' kth scores are in, one for each query.
        state_s = spool(state.withColumn("q", F.monotonically_increasing_id()))

        def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    yield pd.DataFrame({"id": np.frombuffer(row.q_ids, "<i8"), "q": row.q, "want": np.frombuffer(row.want, "<i8")})

        members = state_s.select("q", "q_ids", "want").mapInPandas(own, "id bigint, q bigint, want bigint").join(reach, "id").where("m >= want")
        members = members.groupBy("q", "id").agg(F.max(F.struct("bin", "n", "m")).alias("at")).groupBy("q").agg(F.collect_list(F.struct("id", "at.bin", "at.n", "at.m")).alias("found"))

        def refine(batches: Iterator[pd.DataFrame], width: int = width) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                lows, wants = [], []
                for row in pdf.itertuples():
                    by_id = {x["id"]: x for x in row.found} if row.found is not None else {}
                    low, want = np.frombuffer(row.low, "<i8").copy(), np.frombuffer(row.want, "<i8").copy()
                    for i, q in enumerate(np.frombuffer(row.q_ids, "<i8")):
                        if at := by_id.get(q):
                            want[i] -= at["m"] - at["n"]
                            low[i] += at["bin"] * width
                    lows.append(low.tobytes())
                    wants.append(want.tobytes())
                yield pd.DataFrame({"dim": pdf["dim"], "q_ids": pdf["q_ids"], "q_vectors": pdf["q_vectors"], "low": lows, "want": wants})

        state = spool(state_s.join(members, "q", "left").mapInPandas(refine, state_ddl))
        if width == 1:
            break
        width //= bins

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                q_ids, c_ids, scores = _pair(row)
                kth = np.frombuffer(row.low, "<i8")
                order = np.argsort(c_ids, kind="stable")
                c_ids, scores = c_ids[order], scores[:, order]
                other = q_ids[:, None] != c_ids
                i, j = np.nonzero((scores > kth[:, None]) & other)
                ties = (scores == kth[:, None]) & other
                ties &= np.cumsum(ties, axis=1) <= k
                ti, tj = np.nonzero(ties)
                i, j = np.concatenate([i, ti]), np.concatenate([j, tj])
                yield pd.DataFrame({"query_id": q_ids[i], "vec_id": c_ids[j], "score": scores[i, j]})

    near = scored(state).mapInPandas(select, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
