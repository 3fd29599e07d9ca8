"""A log as a folder of versions: each one a manifest that names the files it is made of.

A version is committed by renaming its manifest into place, which happens at once or not at all: readers keep the version they
opened, an append that is killed leaves the last one as it was, and of two writers one fails. Files belong to the version that
wrote them and are shared by later ones; ``clean`` deletes what no kept version names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions.formats import FORMATS, PLAIN, LogFormat
from ..functions.masking import MaskConfig
from ..functions.timefmt import FAMILIES, CustomFormat
from .spool import kept, spooling_in
from .stored import StoredLines
from .text import FileState


class Conflict(RuntimeError):
    """Another writer committed a version meanwhile."""


class LogFolder:
    """The versions of one log in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str, formats: tuple[LogFormat, ...] = FORMATS):
        self.spark, self.folder, self.formats = spark, folder.rstrip("/"), formats

    # ---- files ----

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str = "") -> list[str]:
        path, fs = self._path(name) if name else self._path(".")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def writing(self):
        """What is spooled inside is written to this folder."""
        return spooling_in(f"{self.folder}/data")

    # ---- versions ----

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names() if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())

    def commit(self, log, note: dict | None = None, after: int | None = None) -> int:
        """Make ``log`` (all of whose tables stand in this folder) the next version, after version ``after`` (by default the
        last one); ``note`` is kept with it. ``Conflict`` if that version is there already."""
        known = self.versions()
        number = (known[-1] if known else 0) + 1 if after is None else after + 1
        tables = {"chunks": log.stored.chunks, "clusters": log.mined.clusters, "children": log.mined.children, "blanks": log.mined.blanks}
        paths = {k: _folders(df) for k, df in tables.items()}
        manifest = {
            "lines": {"paths": list(log.stored.paths), "schema": json.loads(log.stored.lines.schema.json())},
            "tables": {k: {"paths": paths[k], "schema": json.loads(df.schema.json())} for k, df in tables.items()},
            "format": log.fmt.name,
            "family": None if log.family is None else {"custom": asdict(log.family)} if isinstance(log.family, CustomFormat) else log.family.name,
            "custom": [asdict(c) for c in log.custom],
            "header": list(log.header),
            "path": log.path,
            "state": log.state and [log.state.size, log.state.mtime_ns],
            "config": asdict(log.config) | {"now": log.config.now and log.config.now.isoformat()},
            "note": note or {},
        }
        temporary, fs = self._path(f".{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target, _ = self._path(f"v{number}.json")
        if fs.exists(target) or not fs.rename(temporary, target):
            fs.delete(temporary, False)
            raise Conflict(f"version {number} of {self.folder} is there already")
        kept([*log.stored.paths, *[p for x in paths.values() for p in x]])
        return number

    def manifest(self, version: int) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/v{version}.json", wholetext=True).collect()))

    def open(self, version: int | None = None):
        """The log as it was at a version (by default the last one), with its version's ``note``."""
        from ..operators.ingest import AnalysedLog, ParsingConfig
        from ..operators.mining import Mined

        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no version of a log in {self.folder}")
        m = self.manifest(known[-1] if version is None else version)

        def table(x: dict) -> DataFrame:
            return self.spark.read.schema(StructType.fromJson(x["schema"])).parquet(*x["paths"])

        tables = {k: table(x) for k, x in m["tables"].items()}
        schema = StructType.fromJson(m["lines"]["schema"])
        own = StoredLines(self.spark, tuple(m["lines"]["paths"]), schema, [tables["chunks"]])
        mined = Mined(tables["clusters"].limit(0), tables["clusters"], tables["children"], tables["blanks"])
        family = m["family"]
        if family is not None:
            family = CustomFormat(**family["custom"]) if isinstance(family, dict) else next(f for f in FAMILIES if f.name == family)
        fmt = next(f for f in (*self.formats, PLAIN) if f.name == m["format"])
        config = m["config"] | {"masks": MaskConfig(**m["config"]["masks"]), "now": m["config"]["now"] and date.fromisoformat(m["config"]["now"])}
        state = m["state"] and FileState(*m["state"])
        return AnalysedLog(own.lines, mined.templates, fmt, family, tuple(m["header"]), m["path"], state, None, tuple(CustomFormat(**c) for c in m["custom"]), mined, ParsingConfig(**config), own), m["note"]

    def clean(self, keep: int = 2) -> list[str]:
        """Delete all versions but the last ``keep`` and the data that none of these names (of killed appends, too); returns
        the data folders that went. Run it while nobody appends, and with as many versions as readers may hold."""
        known = self.versions()
        gone, staying = known[: max(0, len(known) - keep)], known[-keep:] if keep else []
        named = set()
        for v in staying:
            m = self.manifest(v)
            named |= {p.rsplit("/", 1)[-1] for x in (m["lines"], *m["tables"].values()) for p in x["paths"]}
        for v in gone:
            path, fs = self._path(f"v{v}.json")
            fs.delete(path, False)
        dropped = sorted(n for n in self._names("data") if n not in named)
        for n in dropped:
            path, fs = self._path(f"data/{n}")
            fs.delete(path, True)
        return dropped


def _folders(df: DataFrame) -> list[str]:
    found = sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    if not found:
        raise ValueError("a table of the log was not written")
    return found
