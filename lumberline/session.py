"""An investigation session: loaded logs, their filters, and the tools that answer with plain dictionaries.

Everything here runs on the driver and only composes the operators; a tool collects no more than its page or its top-k.
"""

from __future__ import annotations

import itertools
import json
import os
import threading
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.timefmt import CustomFormat, format_ms, parse_time_param
from .functions.masking import MaskConfig
from .loading import Cancelled, Load
from .operators import analysis, bitmaps, search, sequence
from .operators.ingest import AnalysedLog, ParsingConfig, open_log, refreshed
from .operators.many import open_logs
from .operators.mining import template_counts
from .operators.timecounts import TimeCounts
from .sources.text import FileChange, FileState

NO_LOG = {"comment": "no log", "reason": "no filter is set; add one, or ask with with_filtered_log=False"}


class ToolError(ValueError):
    def payload(self) -> dict[str, Any]:
        return {"error": "tool_error", "message": str(self), "retryable": False}


@dataclass
class Loaded:
    log: AnalysedLog
    whole: AnalysedLog
    filters: search.FilterSet = field(default_factory=search.FilterSet)
    pins: list[dict] = field(default_factory=list)
    applied: str | None = None  # the saved filters that were applied
    matches: bitmaps.MatchBitmaps | None = None  # of the whole log; kept until it is closed, and taken further as it grows
    counts: TimeCounts | None = None
    together: list[str] | None = None  # of logs that were opened together: those that are open still

    @property
    def stored(self):
        """The written lines, if the view is the whole log."""
        return self.log.stored if self.log.window is None else None

    def bitmaps(self) -> bitmaps.MatchBitmaps:
        if self.matches is None:
            self.matches = bitmaps.MatchBitmaps(self.whole.lines)
        return self.matches

    def time_counts(self) -> TimeCounts:
        if self.counts is None:
            self.counts = TimeCounts.of(self.whole.lines)
        return self.counts

    def grown(self, log: AnalysedLog) -> None:
        """The log has more lines: what was made of it is taken further by these alone."""
        first, count = self.whole.stored.count(), log.stored.count()
        more = log.stored.range(first, count)
        if self.matches is not None:
            self.matches = self.matches.extended(log.lines, more)
        if self.counts is not None:
            try:
                self.counts = self.counts.extended(more)
            except ValueError:  # the first times came
                self.counts = None
        self.whole = self.log = log

    def release(self, log_id: str) -> None:
        """Delete what was written for the log; files that it shares with others go with the last of them."""
        if self.together is not None:
            self.together.remove(log_id)
        for made in (self.matches, self.counts, None if self.together else self.whole):
            if made is not None:
                made.release()


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Session:
    """Logs by id (``log_1``, ``log_2``, ...); the last one loaded or chosen is the active one."""

    def __init__(self, spark: SparkSession, config: ParsingConfig | None = None, custom: tuple[CustomFormat, ...] | None = None, store: Store | None = None):
        """``store`` gives saved filters and settings, and where no others are given the configuration and date formats."""
        self.spark, self.store, self.lock = spark, store, threading.RLock()
        self.config = config or (store.parsing() if store else ParsingConfig())
        self.custom = custom if custom is not None else tuple(store.date_formats()) if store else ()
        self.loads: dict[str, tuple[Load, str]] = {}
        self.logs: dict[str, Loaded] = {}
        self.active: str | None = None
        self._ids = itertools.count(1)

    # ---- logs ----

    def load_log(self, path: str) -> dict[str, Any]:
        if not os.path.exists(path):
            raise ToolError(f"no such file: {path}")
        return self.add(open_log(self.spark, path, self.config, self.custom))

    def load_logs(self, paths: list[str]) -> list[dict[str, Any]]:
        """Open many logs in one job; each of them is then a log of its own."""
        if missing := [p for p in paths if not os.path.isfile(p)]:
            raise ToolError(f"no such file: {missing[0]}")
        if not paths:
            return []
        wanted = list(dict.fromkeys(paths))
        states = {p: FileState.of(p) for p in wanted}
        found = open_logs(self.spark, wanted, self.config, self.custom)
        names = {os.path.realpath(unquote(urlparse(r["doc_id"]).path)): r["doc_id"] for r in found.formats.select("doc_id").collect()}
        out, together = [], []
        for p in wanted:
            if os.path.realpath(p) not in names:  # a file without lines
                out.append(self.load_log(p))
                continue
            out.append(self.add(replace(found.log(names[os.path.realpath(p)], p), state=states[p])))
            together.append(out[-1]["log_id"])
            self.logs[together[-1]].together = together
        return out

    def load_start(self, path: str) -> dict[str, Any]:
        """Open a log in the background; ask ``load_status`` for its progress, ``load_cancel`` stops it."""
        if not os.path.exists(path):
            raise ToolError(f"no such file: {path}")
        load_id = f"load_{next(self._ids)}"
        self.loads[load_id] = (Load(self.spark, lambda enter: open_log(self.spark, path, self.config, self.custom, enter=enter)), path)
        return {"load_id": load_id, **self.loads[load_id][0].progress()}

    def _load(self, load_id: str) -> Load:
        if load_id not in self.loads:
            raise ToolError(f"unknown load: {load_id}")
        return self.loads[load_id][0]

    def load_status(self, load_id: str) -> dict[str, Any]:
        """The progress of a load; when it is done the log is added and its statistics are given, once."""
        load = self._load(load_id)
        found = {"load_id": load_id, **load.progress()}
        if load.running:
            return found
        del self.loads[load_id]
        try:
            return found | self.add(load.result())
        except Cancelled:
            return found
        except Exception as e:
            raise ToolError(f"the log can't be loaded: {e}") from e

    def load_cancel(self, load_id: str) -> dict[str, Any]:
        """Stop a load; nothing of it is left."""
        load = self._load(load_id)
        load.cancel()
        return self.load_status(load_id)

    def add(self, log: AnalysedLog) -> dict[str, Any]:
        """Register an analysed log, for instance one made from a table."""
        log_id = f"log_{next(self._ids)}"
        self.logs[log_id] = Loaded(log, log)
        self.active = log_id
        if self.store:
            if log.path:
                self.store.add_recent(log.path)
            if (name := self.store.setting("default_filter")) in self.store.list_filters():
                self.apply_filters(name, log_id)
        return {"log_id": log_id, **self.stats(log_id)}

    def stats(self, log_id: str | None = None) -> dict[str, Any]:
        doc = self._get(log_id)
        one = analysis.summary(doc.log.lines).first()
        top = _rows(doc.log.templates.where("count > 0").orderBy(F.desc("count"), "template_id").limit(5).select("template_id", "pattern", "count"))
        return {
            "path": doc.log.path,
            "file": os.path.basename(doc.log.path),
            "lines": one["lines"],
            "size_bytes": doc.log.state.size if doc.log.state else None,
            "time_range": [format_ms(t) if t is not None else None for t in (one["ts_min_ms"], one["ts_max_ms"])],
            "template_count": one["templates"],
            "top_templates": top,
            "format": doc.log.format_summary,
            "trimmed": doc.log.window is not None,
        }

    def refresh(self, log_id: str | None = None) -> dict[str, Any]:
        """Look at the file of a log again and take in what was appended; filters and tools then see it. A trimmed view becomes
        the whole file. A file that can't be followed gives an error that says why."""
        doc = self._get(log_id)
        if doc.whole.state is None:
            raise ToolError("the log is not a file")
        before = doc.whole
        try:
            now = refreshed(self.spark, before)
        except (OSError, ValueError) as e:
            return ToolError(str(e)).payload()
        if now is before:
            return {"change": FileChange.UNCHANGED.value, **self.stats(log_id)}
        doc.grown(now)
        return {"change": FileChange.APPENDED.value, "appended": now.stored.count() - before.stored.count(), **self.stats(log_id)}

    def poll(self) -> dict[str, dict[str, Any]]:
        """``refresh`` every log that is a file and has changed: what was found by log."""
        with self.lock:
            files = [i for i, d in self.logs.items() if d.whole.state is not None]
            found = {i: self.refresh(i) for i in files}
        return {i: r for i, r in found.items() if r.get("change") != FileChange.UNCHANGED.value}

    def watch(self, seconds: float = 2.0, told: Callable[[dict], None] = lambda found: None) -> Callable[[], None]:
        """``poll`` again and again in the background; ``told`` gets what changed. Returns a function that ends it."""
        over = threading.Event()

        def run() -> None:
            while not over.wait(seconds):
                if found := self.poll():
                    told(found)

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return lambda: (over.set(), thread.join())[0]

    def list_logs(self) -> list[dict[str, Any]]:
        return [{"log_id": i, "path": d.log.path} for i, d in self.logs.items()]

    def close_log(self, log_id: str) -> None:
        self.logs.pop(self._id(log_id)).release(log_id)
        if self.active == log_id:
            self.active = next(reversed(self.logs), None)

    def _id(self, log_id: str | None) -> str:
        found = log_id or self.active
        if found not in self.logs:
            raise ToolError(f"unknown log: {log_id}" if log_id else "no log is loaded")
        return found

    def _get(self, log_id: str | None) -> Loaded:
        return self.logs[self._id(log_id)]

    # ---- views ----

    def _view(self, log_id: str | None, with_filtered_log: bool, start=None, end=None) -> DataFrame | None:
        doc = self._get(log_id)
        if with_filtered_log and not doc.filters.keywords:
            return None
        lines = doc.log.lines
        if start is not None or end is not None:
            r = self._range(doc, start, end)
            lines = doc.stored.range(r.lo, r.hi) if doc.stored else r.lines(lines)
        return search.filtered(lines, doc.filters.keywords) if with_filtered_log else lines

    def _range(self, doc: Loaded, start, end) -> search.Range:
        try:
            return search.resolve_stored(doc.stored, start, end) if doc.stored else search.resolve_range(doc.log.lines, start, end)
        except ValueError as e:
            raise ToolError(str(e)) from e

    def trim(self, start=None, end=None, log_id: str | None = None) -> dict[str, Any]:
        """Narrow the view; bounds count inside the present view; without bounds the whole file is back."""
        doc = self._get(log_id)
        if start is None and end is None:
            doc.log = doc.whole
        else:
            r = self._range(doc, start, end)
            doc.log = doc.log.trim(r.lo, r.hi)
        return self.stats(log_id)

    # ---- filters ----

    def add_filter(self, keyword: str, log_id: str | None = None) -> list[str]:
        try:
            self._get(log_id).filters.add(keyword)
        except ValueError as e:
            raise ToolError(str(e)) from e
        return self.get_filters(log_id)

    def remove_filter(self, position: int, log_id: str | None = None) -> list[str]:
        try:
            self._get(log_id).filters.remove(position)
        except IndexError as e:
            raise ToolError(f"no filter at {position}") from e
        return self.get_filters(log_id)

    def set_filters(self, keywords: list[str], log_id: str | None = None) -> list[str]:
        self._get(log_id).filters = search.FilterSet(keywords)
        return self.get_filters(log_id)

    def get_filters(self, log_id: str | None = None) -> list[str]:
        return list(self._get(log_id).filters.keywords)

    def filter_hits(self, start=None, end=None, log_id: str | None = None) -> list[dict[str, Any]]:
        """How many lines each filter matches, in a range of lines or times if one is given."""
        doc = self._get(log_id)
        names = doc.filters.keywords
        if not names:
            return []
        if not doc.stored:
            lines = self._view(log_id, False, start, end)
            counts = lines.agg(*[F.count_if(search.contains(k)) for k in names]).first()
            return [{"keyword": k, "hits": n} for k, n in zip(names, counts)]
        r = self._range(doc, start, end)
        hits = {x["filter_id"]: x["hits"] for x in doc.bitmaps().hits(names, r.lo, r.hi).collect()}
        return [{"keyword": k, "hits": hits[i]} for i, k in enumerate(names)]

    def _store(self) -> Store:
        if self.store is None:
            raise ToolError("there is no folder for saved filters")
        return self.store

    def saved_filters(self) -> list[str]:
        """The names of the saved filters."""
        return self._store().list_filters()

    def save_filters(self, name: str, log_id: str | None = None) -> list[str]:
        """Save a log's filters under a name."""
        try:
            self._store().save_filter(SavedFilter(name, tuple(self._get(log_id).filters.keywords)))
        except ValueError as e:
            raise ToolError(str(e)) from e
        return self.saved_filters()

    def apply_filters(self, name: str, log_id: str | None = None) -> list[str]:
        """A log gets the filters that were saved under a name, instead of its own."""
        doc = self._get(log_id)
        try:
            doc.filters = search.FilterSet(list(self._store().load_filter(name).keywords))
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise ToolError(f"no filters are saved as {name!r}") from e
        doc.applied = name
        return self.get_filters(log_id)

    # ---- tools ----

    def find_occurrences(self, keyword: str, max_results: int = 50, offset: int = 0, after=None, before=None, context: int = 0, refs: bool = False, with_filtered_log: bool = False, log_id: str | None = None) -> dict[str, Any]:
        lines = self._view(log_id, with_filtered_log)
        if lines is None:
            return dict(NO_LOG)
        window = [None if x is None else parse_time_param(x) for x in (after, before)]
        hits = lines.where(search.contains(keyword) & search.in_window(*window))
        total = hits.agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).first()
        page = search.page(hits, offset, max_results)
        shown = page.select((F.col("line_no") + 1).alias("line"), "ts_ms") if refs else search.payload(page)
        out = {"keyword": keyword, "total": total["n"], "first_seen_ms": total["a"], "last_seen_ms": total["b"], "offset": offset, "results": _rows(shown)}
        if context:
            out["context"] = _rows(sequence.context_runs(lines, page, context).orderBy("hit", "start_line"))
        return out

    def raw_log(self, start, end, max_lines: int = 2000, with_filtered_log: bool = False, log_id: str | None = None) -> dict[str, Any]:
        if start is None or end is None:
            raise ToolError("both bounds are required")
        doc = self._get(log_id)
        if with_filtered_log and doc.filters.keywords and doc.stored:  # from bitmaps and the chunks of the lines shown
            r, names = self._range(doc, start, end), doc.filters.keywords
            view = bitmaps.cut(doc.bitmaps().lanes(names, [True] * len(names), False), r.lo, r.hi)
            total, shown = bitmaps.total(view), bitmaps.page_numbers(view, 0, max_lines)
            rows = _rows(search.payload(doc.stored.at(shown).orderBy("line_no")))
            return {"total": total, "returned": len(rows), "truncated": len(rows) < total, "lines": rows}
        lines = self._view(log_id, with_filtered_log, start, end)
        if lines is None:
            return dict(NO_LOG)
        total = lines.count()
        rows = _rows(search.payload(search.page(lines, 0, max_lines)))
        return {"total": total, "returned": len(rows), "truncated": len(rows) < total, "lines": rows}

    def log_sequence(self, start=None, end=None, max_entries: int = 2000, collapse: bool = False, with_filtered_log: bool = True, log_id: str | None = None) -> dict[str, Any]:
        lines = self._view(log_id, with_filtered_log, start, end)
        if lines is None:
            return dict(NO_LOG)
        entries = _rows(sequence.collapsed_sequence(lines, max_entries) if collapse else sequence.sequence(lines, max_entries))
        return {"total": lines.count(), "returned": sum(e.get("cnt", 1) for e in entries), "entries": entries, "templates": self.get_template(sorted({e["template_id"] for e in entries}), log_id)["templates"]}

    def summarize_log(self, start=None, end=None, with_filtered_log: bool = True, log_id: str | None = None) -> dict[str, Any]:
        lines = self._view(log_id, with_filtered_log, start, end)
        if lines is None:
            return dict(NO_LOG)
        templates = self._get(log_id).log.templates
        names = templates.select("template_id", "pattern")
        errors = _rows(analysis.error_templates(lines, templates))
        overview = analysis.summary(lines).first().asDict()
        patterns = templates.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("template_id", "pattern", "count", "example_line")))), F.lit(0))).first()
        return {
            "overview": overview,
            "template_count": patterns[0],
            "matched_template_count": overview["templates"],
            "error_template_count": analysis.error_counts(lines, templates).first()["templates"],
            "template_size_bytes": patterns[1],
            "sequence_estimate_bytes": overview["sequence_estimate_bytes"],
            "top_templates": _rows(analysis.ranked_templates(lines).join(F.broadcast(names), "template_id").orderBy(F.desc("cnt"), "template_id")),
            "error_templates": [{k: e[k] for k in ("template_id", "pattern", "cnt")} for e in errors],
            "error_lines": errors[0]["error_lines"] if errors else 0,
            "time_gaps": _rows(analysis.time_gaps(lines)),
            "densest_minute": next(iter(_rows(analysis.densest_minute(lines))), None),
        }

    def get_template(self, ids: list[int | str] | None = None, with_filtered_log: bool = False, log_id: str | None = None) -> dict[str, Any]:
        """Templates by id, all without ``ids``; with ``with_filtered_log`` their counts are those of the filtered view."""
        t = self._get(log_id).log.templates
        if with_filtered_log:
            lines = self._view(log_id, True)
            if lines is None:
                return dict(NO_LOG)
            t = template_counts(lines, t)
        try:
            wanted = [int(i) for i in ids] if ids is not None else None
        except ValueError as e:
            raise ToolError("template ids are whole numbers") from e
        rows = _rows((t if wanted is None else t.where(F.col("template_id").isin(wanted))).orderBy("template_id").select("template_id", "pattern", "count", (F.col("example_line") + 1).alias("example_line")))
        return {"template_count": len(rows) if wanted is None else len(wanted), "templates": {r.pop("template_id"): r for r in rows}}

    def get_template_anomalies(self, start=None, end=None, limit: int = 50, with_filtered_log: bool = True, log_id: str | None = None) -> dict[str, Any]:
        lines = self._view(log_id, with_filtered_log, start, end)
        if lines is None:
            return dict(NO_LOG)
        found = _rows(analysis.anomalies(lines, limit))
        return {"anomaly_count": len(found), "anomalies": found}

    def get_template_samples(self, template_id: int, n: int = 3, strategy: str = "first_last_random", with_filtered_log: bool = True, log_id: str | None = None) -> dict[str, Any]:
        lines = self._view(log_id, with_filtered_log)
        if lines is None:
            return dict(NO_LOG)
        try:
            return {"template_id": template_id, "samples": _rows(search.payload(analysis.template_samples(lines, template_id, n, strategy)))}
        except ValueError as e:
            raise ToolError(str(e)) from e

    def get_timeline_histogram(self, start=None, end=None, buckets: int = 50, keyword: str | None = None, template_id: int | None = None, with_filtered_log: bool = True, log_id: str | None = None) -> dict[str, Any]:
        lines = self._view(log_id, with_filtered_log, start, end)
        if lines is None:
            return dict(NO_LOG)
        if keyword is not None and template_id is not None:
            raise ToolError("give a keyword or a template, not both")
        doc = self._get(log_id)
        if keyword is None and template_id is None and start is None and end is None and not with_filtered_log and doc.stored and doc.stored.count():
            counts = doc.time_counts()
            return {"domain": "time" if counts.by_time else "sequence", "buckets": _rows(counts.histogram(min(buckets, 1024)).orderBy("bucket"))}
        chosen = search.find(lines, keyword) if keyword is not None else lines.where(F.col("template_id") == template_id) if template_id is not None else None
        return {"domain": "time" if analysis.domain(lines).first()["by_time"] else "sequence", "buckets": _rows(analysis.histogram(lines, chosen, buckets, most=1024).orderBy("bucket"))}

    def save_pin(self, lines: list[int], comment: str = "", log_id: str | None = None) -> list[dict[str, Any]]:
        """Pin lines (numbered from 1) with a comment; returns all pins in display order."""
        doc = self._get(log_id)
        doc.pins.append({"pin_id": len(doc.pins) + 1, "line_numbers": sorted(n - 1 for n in lines), "comment": comment})
        table = self.spark.createDataFrame([tuple(p.values()) for p in doc.pins], "pin_id bigint, line_numbers array<bigint>, comment string")
        return _rows(sequence.pins(doc.log.lines, table).orderBy("place"))


# ---- saved filters and settings ----


@dataclass(frozen=True)
class SavedFilter:
    name: str
    keywords: tuple[str, ...]


class Store:
    """Saved filters, date formats and recent files as JSON in a folder."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(os.path.join(folder, "filters"), exist_ok=True)

    def _filter_path(self, name: str) -> str:
        if not name or os.path.basename(name) != name:
            raise ValueError("not a filter name")
        return os.path.join(self.folder, "filters", f"{name}.json")

    def save_filter(self, saved: SavedFilter) -> None:
        with open(self._filter_path(saved.name), "w") as f:
            json.dump(asdict(saved), f)

    def load_filter(self, name: str) -> SavedFilter:
        with open(self._filter_path(name)) as f:
            data = json.load(f)
        return SavedFilter(data["name"], tuple(data["keywords"])[: search.MAX_FILTERS])

    def rename_filter(self, old: str, new: str) -> None:
        if old == new:
            return
        if os.path.exists(self._filter_path(new)):
            raise ValueError(f"filters are already saved as {new!r}")
        self.save_filter(replace(self.load_filter(old), name=new))
        os.remove(self._filter_path(old))

    def list_filters(self) -> list[str]:
        return sorted(x.removesuffix(".json") for x in os.listdir(os.path.join(self.folder, "filters")) if x.endswith(".json"))

    def _read(self, name: str, default):
        try:
            with open(os.path.join(self.folder, name)) as f:
                return json.load(f)
        except (OSError, ValueError):
            return default

    def _write(self, name: str, value) -> None:
        with open(os.path.join(self.folder, name), "w") as f:
            json.dump(value, f)

    def date_formats(self) -> list[CustomFormat]:
        """Stored formats; those that don't compile are left out."""
        out = []
        for d in self._read("date_formats.json", []):
            try:
                f = CustomFormat(d["name"], d["pattern"])
                f.compiled()
                out.append(f)
            except (KeyError, TypeError, ValueError):
                continue
        return out

    def save_date_formats(self, formats: list[CustomFormat]) -> None:
        self._write("date_formats.json", [{"name": f.name, "pattern": f.pattern} for f in formats])

    def settings(self) -> dict[str, Any]:
        """What was set; a file that can't be read counts as none."""
        found = self._read("settings.json", {})
        return found if isinstance(found, dict) else {}

    def setting(self, name: str, default: Any = None) -> Any:
        return self.settings().get(name, default)

    def set(self, **changes: Any) -> dict[str, Any]:
        """Change settings (None takes one back): ``default_filter``, or a field of ``ParsingConfig``, checked first."""
        now = {k: v for k, v in (self.settings() | changes).items() if v is not None}
        self._parsing(now)
        self._write("settings.json", now)
        return now

    @staticmethod
    def _parsing(found: dict[str, Any]) -> ParsingConfig:
        kinds = {"similarity": float, "header_sample_lines": int, "depth": int}
        known = {k: kinds[k](v) for k, v in found.items() if k in kinds}
        config = ParsingConfig(**known, masks=MaskConfig(**{k: bool(v) for k, v in found.get("masks", {}).items() if hasattr(MaskConfig, k)}))
        if not 0 <= config.similarity <= 1 or config.header_sample_lines < 0:
            raise ValueError("similarity is from 0 to 1, header_sample_lines not negative")
        config.drain  # checks the depth
        return config

    def parsing(self) -> ParsingConfig:
        """The stored configuration; the usual one where that is none."""
        try:
            return self._parsing(self.settings())
        except (TypeError, ValueError, AttributeError):
            return ParsingConfig()

    def recent(self) -> list[str]:
        return self._read("recent.json", [])

    def add_recent(self, path: str, limit: int = 20) -> list[str]:
        files = [path, *[x for x in self.recent() if x != path]][:limit]
        self._write("recent.json", files)
        return files
