"""From files or tables of lines to an analysed log: times, contents, templates and one row about the file."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import FORMATS, PLAIN, LogFormat, detect_format, learn_header, normalized
from ..functions.masking import MaskConfig
from ..functions.timefmt import CustomFormat, Family, epoch_ms, least_hits, parse, without_time
from ..sources.spool import release, spooled
from ..sources.stored import StoredLines, completed, store
from ..sources.text import FileChange, FileState, first_lines, lines_from, read_lines
from .mining import DrainConfig, Mined, mine_keyed, template_counts, with_keys
from .search import trimmed

#: Lines that aren't blank that a format is found from, and lines at the head of a file that are looked at for them.
SAMPLE_LINES, HEAD_LINES = 512, 2_048


#: What analysing a log goes through.
PHASES = ("sampling", "parsing", "mining", "writing")


@dataclass(frozen=True)
class ParsingConfig:
    """Similarity and depth of mining, and how many lines the header is learnt from."""

    similarity: float = 0.5
    header_sample_lines: int = 200
    depth: int = 4
    masks: MaskConfig = MaskConfig()
    now: date | None = None

    @property
    def drain(self) -> DrainConfig:
        return DrainConfig(self.depth, self.similarity)


@dataclass(frozen=True)
class AnalysedLog:
    """``lines``: doc_id, line_no, text, n_bytes, content, ts_raw_ms, ts_ms, template_id. ``templates``: doc_id,
    template_id, pattern, count, example_line. Views share them; trimming only narrows. ``stored`` are the written lines,
    in order, with their chunks; ``mined`` is what later lines need."""

    lines: DataFrame
    templates: DataFrame
    fmt: LogFormat
    family: Family | CustomFormat | None
    header: tuple[str | None, ...] = ()
    path: str = ""
    state: FileState | None = None
    window: tuple[int, int] | None = None
    custom: tuple[CustomFormat, ...] = field(default=())
    mined: Mined | None = None
    config: ParsingConfig = ParsingConfig()
    stored: StoredLines | None = None

    @property
    def format_summary(self) -> str:
        date_part = "field-based" if self.fmt.name == "json" else self.family.name if self.family else "none"
        return f"format: {self.fmt.name} · date: {date_part}"

    def trim(self, lo: int, hi: int) -> AnalysedLog:
        """The lines from ``lo`` to ``hi`` (not included) of this view, numbered anew, templates counted anew."""
        n = self.stored.count() if self.stored and not self.window else self.lines.count()
        lo, hi = max(0, min(lo, n - 1)), min(hi, n)
        if lo >= hi:
            return self
        start = self.window[0] if self.window else 0
        lines = trimmed(self.lines, lo, hi)
        return replace(self, lines=lines, templates=template_counts(lines, self.templates), window=(start + lo, start + hi))

    def release(self) -> None:
        """Delete what the log has written."""
        if self.stored:
            self.stored.release()
        if self.mined:
            self.mined.release()


def head_of(lines: DataFrame, config: ParsingConfig, path: str | None = None) -> tuple[list[str], list[str]]:
    """(the first 512 lines that aren't blank, the lines that the header is learnt from), as texts; with the ``path`` of the
    only file that they are of, from its first bytes."""
    first = max(HEAD_LINES, config.header_sample_lines)
    rows = first_lines(lines.sparkSession, path, first) if path else None
    if rows is None:
        rows = lines.where(F.col("line_no") < first).orderBy("line_no").select("line_no", "text").collect()
    sample = [r["text"] for r in rows if (r["text"] or "").strip(" ")][:SAMPLE_LINES]
    if len(sample) < SAMPLE_LINES and len(rows) == first:  # many blank lines: look at all
        found = lines.where(F.trim("text") != "").orderBy("line_no").limit(SAMPLE_LINES).select("text").collect()
        sample = [r["text"] for r in found]
    return sample, [r["text"] for r in rows if r["line_no"] < config.header_sample_lines and r["text"] is not None]


def time_family(sample: list[str], families: tuple[Family, ...], custom: tuple[CustomFormat, ...], now: date | None = None) -> Family | CustomFormat | None:
    """``detect_time`` of a few texts, on the driver."""

    def has(text: str, candidate: Family | CustomFormat) -> bool:
        if isinstance(candidate, Family):
            return parse(text, candidate, now) is not None
        try:
            return candidate.components(text) is not None
        except ValueError:
            return False

    candidates = (*families, *custom)
    hits = [sum(has(x, c) for x in sample) for c in candidates]
    best = max(range(len(candidates)), key=lambda i: (hits[i], -i), default=None)
    return candidates[best] if sample and best is not None and hits[best] >= least_hits(len(sample)) else None


def detect_time(sample: DataFrame, families: tuple[Family, ...], custom: tuple[CustomFormat, ...], now: date | None = None) -> Family | CustomFormat | None:
    """What most of the sampled lines have: families before custom formats, earlier before later among equals."""
    candidates = (*families, *custom)
    if not candidates:
        return None
    columns = [c.column(F.col("text")) if isinstance(c, CustomFormat) else epoch_ms(F.col("text"), c, now) for c in candidates]
    n, *hits = sample.agg(F.count(F.lit(1)), *[F.count(c) for c in columns]).first()
    best = max(range(len(candidates)), key=lambda i: (hits[i], -i))
    return candidates[best] if n and hits[best] >= least_hits(n) else None


def time_of(text: Column, family: Family | CustomFormat, now: date | None = None) -> Column:
    return family.column(text) if isinstance(family, CustomFormat) else epoch_ms(text, family, now)


def untimed(text: Column, fmt: LogFormat, family: Family | CustomFormat | None, now: date | None = None) -> Column:
    """What is mined of a line: plain lines lose the time that was read from them."""
    return text if family is None else _rest(text, time_of(text, family, now), fmt, family)


def _rest(text: Column, ts: Column, fmt: LogFormat, family: Family | CustomFormat) -> Column:
    if fmt is not PLAIN:
        return text
    rest = family.without(text) if isinstance(family, CustomFormat) else without_time(text, family)
    return F.when(ts.isNotNull(), rest).otherwise(text)


def analyse(
    lines: DataFrame, config: ParsingConfig = ParsingConfig(), custom: tuple[CustomFormat, ...] = (), path: str = "", state: FileState | None = None, formats: tuple[LogFormat, ...] = FORMATS, families: tuple[Family, ...] = (), enter: Callable[[str], None] = lambda phase: None, one_file: bool = False
) -> AnalysedLog:
    """Analyse ``lines`` (doc_id, line_no, text, n_bytes) of one log. ``formats`` are tried before plain text; ``families``
    are further families of plain lines. ``enter`` is called with the name of each phase as it begins. With ``one_file`` the lines are those of the file ``path``.

    Format, family and header come from the first lines (512 that aren't blank, and 200). Lines are normalised in one
    Arrow-batched pass, and written; templates are mined from numbers and contents, in parallel; then lines, filled times and
    templates are written once, in order, and all queries of the result read that.
    """
    enter("sampling")
    sample, head = head_of(lines, config, path if one_file else None)
    spark = lines.sparkSession
    table = spark.createDataFrame([(x,) for x in sample], "text string")
    fmt = detect_format(table, formats)
    family = time_family(sample, (*fmt.families, *families) if fmt is PLAIN else fmt.families, custom, config.now)
    header: tuple[str | None, ...] = ()
    rest = untimed(F.col("text"), fmt, family, config.now)
    if fmt is PLAIN and head:
        heads = spark.createDataFrame([(x,) for x in head], "text string").select(rest.alias("x")).where(F.trim("x") != "").collect()
        header = learn_header([r["x"] for r in heads])
    found, own = _mined_and_stored(parsed(lines, fmt, family, header, config), config, enter=enter)
    return AnalysedLog(own.lines, found.templates, fmt, family, header, path, state, None, tuple(custom), found, config, own)


def _mined_and_stored(done: DataFrame, config: ParsingConfig, before: Mined | None = None, start: int | None = None, enter: Callable[[str], None] = lambda phase: None) -> tuple[Mined, StoredLines]:
    enter("parsing")
    keyed = spooled(with_keys(done, config.drain))
    enter("mining")
    found = mine_keyed(keyed, config.drain, before)
    enter("writing")
    own = store(completed(keyed.select(*done.columns), found.births, start))
    release(keyed)
    release(found.found)
    return found, own


def parsed(lines: DataFrame, fmt: LogFormat, family: Family | CustomFormat | None, header: tuple[str | None, ...], config: ParsingConfig) -> DataFrame:
    """``lines`` with ``content`` and ``ts_raw_ms``."""
    if family is None:
        return normalized(lines, fmt, header, config.masks).withColumnRenamed("field_ms", "ts_raw_ms")
    timed = lines.withColumn("ts_raw_ms", time_of(F.col("text"), family, config.now))  # read once, used twice
    raw = timed.withColumn("__mined", _rest(F.col("text"), F.col("ts_raw_ms"), fmt, family))
    done = normalized(raw, fmt, header, config.masks, "__mined")
    return done.select(*lines.columns, "content", "ts_raw_ms")


def append(log: AnalysedLog, lines: DataFrame, state: FileState | None = None) -> AnalysedLog:
    """The log with further ``lines`` (numbered on), read by the format, family and header that it has. Only these lines are
    parsed and mined; earlier templates may become more general."""
    if log.window is not None:
        raise ValueError("a trimmed view can't be appended to")
    before = log.stored.last_time()
    found, more = _mined_and_stored(parsed(lines, log.fmt, log.family, log.header, log.config), log.config, log.mined, before)
    every = log.stored.with_more(more)
    return replace(log, lines=every.lines, templates=found.templates, mined=found, state=state, stored=every)


def refreshed(spark: SparkSession, log: AnalysedLog) -> AnalysedLog:
    """The log of a file that may have grown: itself if nothing changed, with the appended lines if only these are new.

    A file that has shrunk, was edited in place, or whose last line had no end yet raises a ``ValueError`` that says which;
    it has to be opened anew. Bytes that were read before are not read again.
    """
    now = FileState.of(log.path)
    change = log.state.change(now)
    if change is FileChange.UNCHANGED:
        return log
    if change is FileChange.SHRUNK:
        raise ValueError(f"{log.path} has shrunk; a full reload is required")
    if change is FileChange.MODIFIED:
        raise ValueError(f"{log.path} was modified in place; a full reload is required")
    with open(log.path, "rb") as f:
        f.seek(max(0, log.state.size - 1))
        if log.state.size and f.read(1) != b"\n":
            raise ValueError(f"the last line of {log.path} has grown; a full reload is required")
    known = log.stored.chunks.select("doc_id").first()
    return append(log, lines_from(spark, log.path, log.state.size, log.stored.count(), now.size, known and known[0]), now)


def open_log(spark: SparkSession, path: str, config: ParsingConfig = ParsingConfig(), custom: tuple[CustomFormat, ...] = (), **more) -> AnalysedLog:
    """Read and analyse one log file of any extension (``more``: parameters of ``analyse``)."""
    state = FileState.of(path) if os.path.exists(path) else None
    return analyse(read_lines(spark, path), config, custom, path, state, one_file=os.path.isfile(path), **more)
