"""Many logs in one job: each document's format, family of times and header are found from its own first lines, by grouped
work, and then all lines are read, mined and written together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formats import FORMATS, PLAIN, LogFormat, learn_header
from ..functions.masking import MaskConfig, mask_line, mask_lines
from ..functions.timefmt import CustomFormat, Family, least_hits, parse
from ..sources.spool import spooled
from ..sources.stored import StoredLines
from ..sources.text import read_lines
from .ingest import HEAD_LINES, SAMPLE_LINES, AnalysedLog, ParsingConfig, _mined_and_stored, _rest, time_family, time_of
from .mining import Mined

#: Documents whose formats are joined to the lines by broadcast; beyond it they are shuffled.
BROADCAST_DOCUMENTS = 100_000


@dataclass(frozen=True)
class AnalysedLogs:
    """``lines`` and ``templates`` as of one log, of all documents; ``formats``: doc_id, format, family, header."""

    lines: DataFrame
    templates: DataFrame
    formats: DataFrame
    mined: Mined
    stored: StoredLines
    custom: tuple[CustomFormat, ...]
    config: ParsingConfig
    known: tuple[LogFormat, ...]
    families: tuple[Family, ...]

    def log(self, doc_id: str, path: str = "") -> AnalysedLog:
        """One of the logs, as if it had been opened alone."""
        row = self.formats.where(F.col("doc_id") == doc_id).first()
        if row is None:
            raise KeyError(doc_id)
        fmt = next(f for f in (*self.known, PLAIN) if f.name == row["format"])
        family = next((f for f in (*fmt.families, *self.families, *self.custom) if f.name == row["family"]), None)
        own = self.stored.document(doc_id)
        only = lambda df: df.where(F.col("doc_id") == doc_id)
        mined = Mined(only(self.mined.found), only(self.mined.clusters), only(self.mined.children), only(self.mined.blanks))
        return AnalysedLog(own.lines, mined.templates, fmt, family, tuple(row["header"]), path, None, None, self.custom, mined, self.config, own)

    def release(self) -> None:
        self.stored.release()
        self.mined.release()


def found_formats(lines: DataFrame, config: ParsingConfig = ParsingConfig(), custom: tuple[CustomFormat, ...] = (), formats: tuple[LogFormat, ...] = FORMATS, families: tuple[Family, ...] = ()) -> DataFrame:
    """(doc_id, format, family, header) of each document of ``lines`` (doc_id, line_no, text), from its first 512 lines that
    aren't blank and the lines that its header is learnt from.

    The samples are cut inside each task before they meet; a document's sample is what one task holds.
    """
    text, blank = F.col("text"), F.coalesce(F.trim("text") == "", F.lit(True))
    rank = Window.partitionBy("doc_id", "__blank").orderBy("line_no")
    ranked = lines.select("doc_id", "line_no", "text", blank.alias("__blank")).withColumn("__nth", F.row_number().over(rank))
    wanted = ranked.where((F.col("__nth") <= max(SAMPLE_LINES, config.header_sample_lines)) & ((F.col("__nth") <= SAMPLE_LINES) & ~F.col("__blank") | (F.col("line_no") < config.header_sample_lines)))
    sample = spooled(wanted.select("doc_id", "line_no", "text", (~F.col("__blank") & (F.col("__nth") <= SAMPLE_LINES)).alias("counts"), F.array(*[f.matches(text) for f in formats]).alias("is")))
    names = [f.name for f in formats]

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line_no")
        counted = rows[rows["counts"]]
        texts = counted["text"].tolist()
        hits = np.array([list(x) for x in counted["is"]], bool).reshape(len(texts), len(names)).sum(axis=0)
        best = int(hits.argmax()) if len(names) else None
        fmt = formats[best] if texts and best is not None and hits[best] >= least_hits(len(texts)) else PLAIN
        family = time_family(texts, (*fmt.families, *families) if fmt is PLAIN else fmt.families, custom, config.now)
        header = learn_header([x for x in map(lambda t: untimed_text(t, family, config.now), _head(rows, config)) if x.strip(" ")]) if fmt is PLAIN else ()
        return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "format": [fmt.name], "family": [family and family.name], "header": [list(header)]})

    kind = lines.schema["doc_id"].dataType.simpleString()
    return sample.groupBy("doc_id").applyInPandas(lambda rows: decide(rows), f"doc_id {kind}, format string, family string, header array<string>")


def _head(rows: pd.DataFrame, config: ParsingConfig) -> list[str]:
    own = rows[rows["line_no"] < config.header_sample_lines]["text"]
    return [x for x in own.tolist() if x is not None]


def untimed_text(text: str, family: Family | CustomFormat | None, now) -> str:
    """``ingest.untimed`` of one plain line."""
    if family is None:
        return text
    if isinstance(family, CustomFormat):
        try:
            found = family.components(text)
        except ValueError:
            return text
        span = found and found[1]
    else:
        found = parse(text, family, now)
        span = found and found[1]
    return text if not found else text[: span[0]] + text[span[1] :]


def normalized_each(lines: DataFrame, formats: tuple[LogFormat, ...], config: MaskConfig, text_col: str) -> DataFrame:
    """``formats.normalized`` with the format and header of each row (``__format``, ``__header``)."""
    known = {f.name: f for f in (*formats, PLAIN)}

    def run(texts: pa.Array, names: pa.Array, headers: pa.Array) -> pa.Array:
        content, field = [None] * len(texts), [None] * len(texts)
        keys = [(n, tuple(h or ())) for n, h in zip(names.to_pylist(), headers.to_pylist())]
        for key in dict.fromkeys(keys):
            at = [i for i, k in enumerate(keys) if k == key]
            some = texts.take(pa.array(at))
            if key[0] == PLAIN.name:
                done = [(x, None) for x in mask_lines(pc.cast(some, pa.string()), key[1], config).to_pylist()]
            else:
                done = [(None, None) if t is None else known[key[0]].normalize(t, lambda x: mask_line(x, (), config)) for t in some.to_pylist()]
            for i, (c, f) in zip(at, done):
                content[i], field[i] = c, f
        return pa.StructArray.from_arrays([pa.array(content, pa.string()), pa.array(field, pa.int64())], ["content", "field_ms"])

    convert = F.arrow_udf(run, "content string, field_ms bigint")
    return lines.withColumn("__n", convert(F.col(text_col), F.col("__format"), F.col("__header")))


def analyse_many(lines: DataFrame, config: ParsingConfig = ParsingConfig(), custom: tuple[CustomFormat, ...] = (), formats: tuple[LogFormat, ...] = FORMATS, families: tuple[Family, ...] = ()) -> AnalysedLogs:
    """Analyse the documents of ``lines`` (doc_id, line_no, text, n_bytes) in one job, each as if it were a log alone.

    Only the kinds of documents (format and family) come to the driver: formats times families at most.
    """
    found = spooled(found_formats(lines, config, custom, formats, families))
    kinds = [tuple(r) for r in found.select("format", "family").distinct().collect()]
    own = found.select(F.col("doc_id").alias("__d"), F.col("format").alias("__format"), F.col("family").alias("__family"), F.col("header").alias("__header"))
    small = found.limit(BROADCAST_DOCUMENTS + 1).count() <= BROADCAST_DOCUMENTS
    rows = lines.join(F.broadcast(own) if small else own, F.col("doc_id") == F.col("__d"))
    by_name = {f.name: f for f in (*formats, PLAIN)}
    text, ts, rest = F.col("text"), F.lit(None).cast("bigint"), F.col("text")
    for name, family_name in kinds:
        fmt = by_name[name]
        family = next((f for f in (*fmt.families, *families, *custom) if f.name == family_name), None)
        if family is not None:
            here = (F.col("__format") == name) & (F.col("__family") == family_name)
            ts = F.when(here, time_of(text, family, config.now)).otherwise(ts)
            rest = F.when(here, _rest(text, F.col("__ts"), fmt, family)).otherwise(rest)
    timed = rows.withColumn("__ts", ts).withColumn("__rest", rest)
    done = normalized_each(timed, formats, config.masks, "__rest")
    done = done.select(*lines.columns, F.col("__n.content").alias("content"), F.when(F.col("__family").isNull(), F.col("__n.field_ms")).otherwise(F.col("__ts")).alias("ts_raw_ms"))
    mined, stored = _mined_and_stored(done, config)
    return AnalysedLogs(stored.lines, mined.templates, found, mined, stored, tuple(custom), config, formats, families)


def open_logs(spark: SparkSession, paths: list[str], config: ParsingConfig = ParsingConfig(), custom: tuple[CustomFormat, ...] = (), **more) -> AnalysedLogs:
    """Read and analyse many files together (``more``: parameters of ``analyse_many``). Documents are named by their files'
    full addresses."""
    return analyse_many(read_lines(spark, paths), config, custom, **more)
