"""Helpers shared by the corpus operators: spooling, scalable ordinals, row keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Whitespace that separates words in every operator of this package.
WORD_BREAKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_spooled: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset a temporary folder is made, on a local master only.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lumberline-")
        context.setCheckpointDir(folder)
    return folder


def spool(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it as read from there, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/spool-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _spooled:
        atexit.register(clear_spools)
    _spooled.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_spool(df: DataFrame) -> None:
    """Delete the files of a spooled table that nothing reads any more (one of an earlier iteration)."""
    for name in df.inputFiles()[:1]:
        folder = name.rsplit("/", 1)[0]
        for entry in [e for e in _spooled if e[1].rsplit("/", 1)[-1] == folder.rsplit("/", 1)[-1]]:
            _spooled.remove(entry)
            _delete(*entry)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``df`` written to the shared folder in buckets by ``column``, so that groups by it need no shuffle."""
    spark = df.sparkSession
    name = f"lumberline_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/spool-{name}"
    df.write.bucketBy(buckets, column).format("parquet").option("path", path).saveAsTable(name)
    if not _tables:
        atexit.register(clear_tables)
    _tables.append((spark, name, path))
    return spark.table(name)


def _drop(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    _delete(spark, path)


def clear_tables() -> None:
    while _tables:
        try:
            _drop(*_tables.pop())
        except Exception:  # the session may have ended before
            return


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_spools() -> None:
    """Delete all spooled tables; runs when the driver ends."""
    while _spooled:
        try:
            _delete(*_spooled.pop())
        except Exception:  # the session may have ended before
            return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def seeded_hash(seed: int, *columns: Column) -> Column:
    """64-bit hash of the columns that depends on ``seed``; nulls hash like a marker of their own."""
    return F.xxhash64(F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\u0000null")) for c in columns])


def ordinal_within(df: DataFrame, key: str, hashed: str, out: str, rows_per_task: int = 50_000) -> DataFrame:
    """Add ``out``: the 0-based ordinal of each row among the rows of its ``key``, ordered by the 64-bit column ``hashed``.

    A key with a third of all rows is no hot task: each key is cut along ``hashed`` into slices of about
    ``rows_per_task`` rows. The slices are counted first (partial sums, one row for each key and slice), their running
    totals give each slice its first ordinal, and rows are numbered inside slices only. Nulls of ``key`` are one key.
    """
    slices = max(1, -(-df.count() // rows_per_task), min(64, n_partitions(df.sparkSession)))
    step = (1 << 64) // slices
    cut = F.expr(f"least({slices - 1}, cast((cast(`{hashed}` as decimal(20,0)) + 9223372036854775808) div {step} as int))")
    cut_name, base, same = "__slice", "__base", "__key"
    rows = df.withColumn(cut_name, cut)
    counts = rows.groupBy(F.col(key).alias(same), cut_name).agg(F.count(F.lit(1)).alias("__n"))
    running = Window.partitionBy(same).orderBy(cut_name).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(same, F.col(cut_name).alias("__cut"), F.coalesce(F.sum("__n").over(running), F.lit(0)).alias(base))
    inside = Window.partitionBy(key, cut_name).orderBy(hashed)
    joined = rows.withColumn("__i", F.row_number().over(inside)).join(starts, F.col(key).eqNullSafe(F.col(same)) & (F.col(cut_name) == F.col("__cut")))
    return joined.withColumn(out, F.col(base) + F.col("__i") - 1).drop(cut_name, "__cut", base, "__i", same)
