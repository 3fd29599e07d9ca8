"""Global shuffle of a table into shards by a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash; pass two shuffles each bucket in memory
(Fisher-Yates, seeded by the bucket) and numbers its records. Buckets laid end to end are the shuffled table, cut into
shards whose row counts differ by one at most (the ``rows`` law).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, seeded_hash

BUCKET_BYTES = 16 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> list[int]:
    """The shuffled order of ``n`` records, by swaps from the end."""
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).random(n)
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(
    df: DataFrame, shards: int = 24, seed: int = 20_240_501, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Every row of ``df`` with ``shuffle_bucket``, ``shuffle_position`` (0-based place in the shuffled table),
    ``shard`` and ``slot`` (0-based place in the shard).

    Rows are spread by id and text together, so copies of one text spread by their ids, and rows without an id by their
    texts; only rows alike in both share a bucket, which a task holds. Null ids and null texts are ordinary values; repeated rows are kept, each with its own place; an empty table gives an empty result.
    Columns of ``df`` that bear one of the new names are replaced. The result depends on the rows, ``shards`` and
    ``seed``, not on partitions: a bucket is first sorted by the hash of its rows.
    """
    spark = df.sparkSession
    if shards < 1:
        raise ValueError("shards must be at least 1")
    df = df.drop("shuffle_bucket", "shuffle_position", "shard", "slot")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 8
    total, rows = df.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil(total / bucket_bytes), n_partitions(spark))
    hashed = df.withColumn("__hash", seeded_hash(seed, F.col(id_col), F.col(text_col))).withColumn("shuffle_bucket", F.pmod(F.col("__hash"), F.lit(buckets)).cast("int"))

    names = df.columns
    columns = [f"__c{i}" for i in range(len(names))]  # grouping doesn't take every name
    hashed = hashed.toDF(*columns, "__hash", "shuffle_bucket")
    id_at = columns[names.index(id_col)]

    def shuffle_bucket(table: pa.Table, first: pa.Table) -> pa.Table:
        bucket, start = (first.column(c)[0].as_py() for c in ("__bucket", "__start"))
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("__hash", "ascending"), (id_at, "ascending")]))
        table = table.take(pa.array(fisher_yates(table.num_rows, seed, bucket), pa.int64()))
        return table.select([*columns, "shuffle_bucket"]).append_column("shuffle_position", pa.array(start + np.arange(table.num_rows), pa.int64()))

    schema = hashed.drop("__hash").withColumn("shuffle_position", F.lit(0).cast("long")).schema
    counts = hashed.groupBy(F.col("shuffle_bucket").alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
    # The starts come to the buckets by the texts' own shuffle: a join with the shuffled texts would write them once more.
    placed = hashed.groupBy("shuffle_bucket").cogroup(bucket_starts(counts).groupBy("__bucket")).applyInArrow(shuffle_bucket, schema)
    divisor = max(1, rows)
    out = placed.withColumn("shard", F.expr(f"cast(((shuffle_position + 1) * {shards} - 1) div {divisor} as int)"))
    out = out.withColumn("slot", F.expr(f"shuffle_position - (cast(shard as bigint) * {divisor}) div {shards}"))
    return out.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], "shuffle_bucket", "shuffle_position", "shard", "slot")


def bucket_starts(counts: DataFrame) -> DataFrame:
    """The position of each bucket's first record. ``counts`` has one row for each bucket of 16 MB, some millions for
    100 TB; running totals are taken in groups of 4,096 buckets, and over the groups."""
    group = F.expr("__bucket div 4096")
    groups = counts.groupBy(group.alias("__group")).agg(F.sum("__n").alias("__m"))
    before = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("__group", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__first"))
    starts = counts.withColumn("__group", group).join(groups, "__group")
    return starts.select("__bucket", (F.col("__first") + F.coalesce(F.sum("__n").over(inside), F.lit(0))).alias("__start"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write each shard to its own folder ``shard=<n>``, by slot; bounded files, one task for each bucket and shard."""
    ordered = shuffled.repartition("shard", "shuffle_bucket").sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(path)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return external_shuffle(docs.select("doc_id", "text")).select(
        "doc_id",
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
