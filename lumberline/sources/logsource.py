"""A stored log as a data source: ``spark.read.format("lumberline-log").option("folder", ...)``.

Bounds on ``line_no``, ``ts_ms`` and ``doc_id`` reach the table of chunks: only files with a chunk that can hold such lines
become partitions, and inside a file the statistics of row groups leave out the rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_TESTS = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: The least and the greatest value of a chunk, by column.
_BOUNDS = {"line_no": ("first_line", "last_line"), "ts_ms": ("lo_ms", "hi_ms"), "doc_id": ("doc_id", "doc_id")}


def _place(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address if ":/" in address else f"file://{address}")


def _manifest(folder: str, version: str | None) -> dict:
    system, path = _place(folder)
    if version is None:
        names = [f.base_name for f in system.get_file_info(fs.FileSelector(path))]
        numbers = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit()]
        if not numbers:
            raise FileNotFoundError(f"no version of a log in {folder}")
        version = str(max(numbers))
    with system.open_input_stream(f"{path}/v{int(version)}.json") as f:
        return json.loads(f.read())


def _test(column: ds.Expression, op: str, value) -> ds.Expression:
    value = pa.scalar(value)
    return {"==": column == value, ">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value}[op]


def _can_hold(name: str, op: str, value) -> ds.Expression:
    """Whether a chunk can hold a line that passes a test."""
    lo, hi = (ds.field(x) for x in _BOUNDS[name])
    if op == "==":
        return _test(lo, "<=", value) & _test(hi, ">=", value)
    return _test(lo, op, value) if op in ("<", "<=") else _test(hi, op, value)


@dataclass
class LogFile(InputPartition):
    file: str


class LogReader(DataSourceReader):
    def __init__(self, schema: StructType, manifest: dict):
        self.schema, self.manifest = schema, manifest
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in _BOUNDS and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], _TESTS[type(f)], f.value))
            yield f  # Spark tests the rows again

    def partitions(self) -> list[LogFile]:
        wanted = ds.scalar(True)
        for test in self.tests:
            wanted = wanted & _can_hold(*test)
        files: set[str] = set()
        for address in self.manifest["tables"]["chunks"]["paths"]:
            system, path = _place(address)
            table = ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False).to_table(columns=["file"], filter=wanted)
            files |= set(table.column("file").unique().to_pylist())
        return [LogFile(f) for f in sorted(files)] or [LogFile("")]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        wanted = ds.scalar(True)
        for name, op, value in self.tests:
            wanted = wanted & _test(ds.field(name), op, value)
        system, path = _place(partition.file)
        target = to_arrow_schema(self.schema)
        for batch in ds.dataset(path, filesystem=system, format="parquet").to_batches(columns=self.schema.names, filter=wanted):
            if batch.num_rows:
                yield batch.cast(target)


class LogSource(DataSource):
    """Options: ``folder`` of a log's versions, ``version`` (the last one without it)."""

    @classmethod
    def name(cls) -> str:
        return "lumberline-log"

    def _read(self) -> dict:
        return _manifest(self.options["folder"], self.options.get("version"))

    def schema(self) -> StructType:
        return StructType.fromJson(self._read()["lines"]["schema"])

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(schema, self._read())


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)
