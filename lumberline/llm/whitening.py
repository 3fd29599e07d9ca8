"""Whitening of embeddings by principal components.

Vectors become whole numbers, and each distinct one counts once. Each partition computes its count, exact sums, mean and
centred scatter; pairs of partitions merge by Chan's formula in a tree reduction, so the driver gets a few matrices. It
takes the eigenvectors of the covariance there, and a second pass over the same vectors measures how far the covariance of
the whitened ones is from the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_spool, read, spool

#: An entry c becomes floor(SCALE * c) + OFFSET; entries of LARGEST or more have no exact sums in 64 bits.
SCALE, OFFSET, LARGEST = 64, 1_000_000, float(1 << 34)
COMPONENTS = 16
#: Dimensions up to which the driver takes a covariance (its square of doubles: 128 MB).
MOST_DIMENSIONS = 4096
#: Rows that a worker multiplies at a time, in entries.
BLOCK_ENTRIES = 1 << 21


def whole_numbers(df: DataFrame, vector_col: str, keep: list[str] = [], scale: int = SCALE, offset: int = OFFSET) -> DataFrame:  # noqa: B006
    """The columns ``keep`` and ``x``, the vector in whole numbers, of rows whose vector has entries, and finite ones only."""
    v = F.col(vector_col)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    return df.where(usable).select(*keep, F.transform(v, lambda c: F.floor(c.cast("double") * scale) + offset).alias("x"))


@dataclass
class Moments:
    """Count, exact sums, mean and centred scatter of rows (less a fixed shift, so that the mean keeps its digits)."""

    n: int
    total: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def none(cls, d: int) -> Moments:
        return cls(0, [0] * d, np.zeros(d), np.zeros((d, d)))

    @classmethod
    def of(cls, rows: np.ndarray, total: list[int] | None = None) -> Moments:
        mean = rows.mean(axis=0)
        centred = rows - mean
        return cls(len(rows), total or [0] * rows.shape[1], mean, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        """Chan's formula."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n / n * other.n)
        return Moments(n, [a + b for a, b in zip(self.total, other.total)], self.mean + apart * (other.n / n), scatter)

    def packed(self) -> tuple[int, list[str], bytes, bytes]:
        return self.n, [str(t) for t in self.total], self.mean.tobytes(), self.scatter.tobytes()

    @classmethod
    def unpacked(cls, row) -> Moments:
        d = len(row["total"])
        return cls(row["n"], [int(t) for t in row["total"]], np.frombuffer(row["mean"]), np.frombuffer(row["scatter"]).reshape(d, d))


def matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """The vectors of batches (their last column) as matrices of a bounded size."""
    step = max(1, BLOCK_ENTRIES // d)
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            column = batch.column(batch.num_columns - 1).slice(lo, step)
            yield column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def moments(vectors: DataFrame, d: int, out: int, rows_of: Callable[[np.ndarray], np.ndarray], sums: bool = False) -> Moments:
    """The moments of ``rows_of`` each block of the ``x`` of ``vectors``, with ``out`` columns; with ``sums`` also those of x."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Moments.none(out)
        for x in matrices(batches, d):
            found = found.merged(Moments.of(rows_of(x), [int(t) for t in x.sum(axis=0)] if sums else None))
        yield pa.RecordBatch.from_pylist([dict(zip(("n", "total", "mean", "scatter"), found.packed()))], schema)

    schema = pa.schema([("n", pa.int64()), ("total", pa.list_(pa.string())), ("mean", pa.binary()), ("scatter", pa.binary())])
    parts = vectors.select("x").mapInArrow(partial, "n bigint, total array<string>, mean binary, scatter binary").rdd
    if not parts.getNumPartitions():
        return Moments.none(out)
    return parts.map(Moments.unpacked).treeReduce(Moments.merged)


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with ``total`` per dimension; of each component the eigenvalue, its share of the trace, and the
    eigenvector (a row). ``identity_error``: the largest absolute entry of the whitened vectors' covariance less the identity,
    over the components with variance."""

    n: int
    total: tuple[int, ...] = ()
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    explained: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    identity_error: float = 0.0

    @property
    def dimensions(self) -> int:
        return len(self.total)

    @property
    def live(self) -> np.ndarray:
        """Whether a component has variance beyond rounding."""
        least = self.dimensions * np.finfo(float).eps * (self.values[0] if len(self.values) else 0.0)
        return self.values > max(least, 0.0)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x less the whole part of the mean, the rest of the sums): both small, so nothing is lost."""
        whole = np.array([t // self.n for t in self.total], np.int64)
        rest = np.array([t % self.n for t in self.total], np.int64)
        return x - whole, rest

    def transformed(self, x: np.ndarray) -> np.ndarray:
        """The whitened components of rows of whole numbers; NaN where a component has no variance."""
        near, rest = self.centred(x)
        root = np.sqrt(np.where(self.live, self.values, np.nan))
        return (near - rest / self.n) @ (self.vectors / root[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum of (n x - total)^2, exactly; None beyond 64 bits."""
        near, rest = self.centred(x)
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if self.dimensions * most * most < 1 << 63:
            return ((self.n * near - rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * near.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact.tolist()]


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening:
    """The whitening of the distinct vectors of ``df``, by ``components`` principal components at most.

    Vectors are of the most frequent length (of equals the longest); others take no part, nor do nulls, empty ones, and
    those with a null, non-finite or giant (2**34) entry. Repeated rows count once. An empty table gives a whitening of no
    dimension. Components without variance (few or equal vectors) are kept, with no whitened values. Vectors are compared as
    they are, after partial aggregation, so a vector of a third of all rows is one row for each task. More than 4,096
    dimensions raise a ``ValueError``: the driver holds the covariance.
    """
    vectors = whole_numbers(df, vector_col, scale=scale, offset=offset)
    sizes = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return Whitening(0)
    d = sizes["d"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; at most {MOST_DIMENSIONS} are whitened")
    distinct = spool(vectors.where(F.size("x") == d).distinct())
    found = moments(distinct, d, d, lambda x: (x - offset).astype(float), sums=True)
    values, columns = np.linalg.eigh(found.scatter / found.n)
    values, rows = np.maximum(values[::-1], 0.0), columns.T[::-1]
    trace = values.sum()
    values, rows = values[:components], rows[:components]
    rows = rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]  # either sign will do: this one
    fitted = Whitening(found.n, tuple(found.total), values, values / trace if trace else values, rows)
    live = fitted.live
    error = 0.0
    if live.any():
        again = moments(distinct, d, int(live.sum()), lambda x: fitted.transformed(x)[:, live])
        error = float(np.abs(again.scatter / again.n - np.eye(int(live.sum()))).max())
    drop_spool(distinct)
    return Whitening(fitted.n, fitted.total, values, fitted.explained, rows, error)


def whitened(df: DataFrame, model: Whitening, id_col: str, vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(``id_col``, deviation, whitened): each row that can take part, with its whitened components (null: without variance).

    Rows that the fit leaves out have no result. Null and repeated ids are kept. The model goes to each task: as many numbers
    as dimensions times components.
    """
    d, kind = model.dimensions, df.schema[id_col].dataType.simpleString()
    rows = whole_numbers(df, vector_col, [F.col(id_col).alias("__id")], scale, offset).where(F.size("x") == d)
    step = max(1, BLOCK_ENTRIES // max(d, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, start = batch.column(0), 0
            for x in matrices(iter([batch]), d):
                values = model.transformed(x)
                flat = pa.array(values.ravel(), pa.float64(), mask=np.isnan(values.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * values.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([ids.slice(start, step), pa.array(model.deviations(x), pa.int64()), lists], ["__id", "deviation", "whitened"])
                start += len(x)

    done = rows.mapInArrow(run, f"__id {kind}, deviation bigint, whitened array<double>")
    return done.withColumnRenamed("__id", id_col)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    model = fit_whitening(rows)
    explained = F.array(*map(F.lit, model.explained.tolist())).cast("array<double>")
    each = whitened(rows, model, "vec_id").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error")
    )
