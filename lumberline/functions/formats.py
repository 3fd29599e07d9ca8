"""Log formats: which one a file is in, and what each makes of a line before mining.

A format's test is a native predicate, so that detection is one aggregate over a sample. Its normaliser works line by
line in Python (dictionaries and word lists) and runs Arrow-batched in ``normalized``; a registry takes further formats.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masking import MaskConfig, classify_token, mask_line, masked_lines, split_tokens
from .timefmt import BY_NAME, FAMILIES, Family, least_hits, parse, parse_time_param

# Word lists of the formats.
OS_LEVELS = ("Default", "Info", "Debug", "Error", "Fault", "Activity", "Notice", "Trace")
OS_TYPE_CODES = ("Df", "Db", "I", "E", "F", "A", "N", "T")
CONSOLE_LEVELS = ("INFO", "DEBUG", "ERROR", "WARNING", "WARN", "NOTICE", "FAULT", "CRITICAL", "TRACE", "DEFAULT", "Info", "Debug", "Error", "Fault", "Default", "Notice", "Trace", "Warning")
TIME_KEYS = ("time", "timestamp", "@timestamp", "ts", "datetime")
MESSAGE_KEYS = ("msg", "message", "log", "text", "event")

Masker = Callable[[str], str]
HEX_ID = re.compile(r"0[xX][0-9A-Fa-f]+")
ISO = BY_NAME["ISO-8601"]


@dataclass(frozen=True)
class LogFormat:
    """``matches`` is a predicate on the text column; ``normalize`` gives the content to mine and, for formats whose time
    is a field, the time; ``families`` are the positional timestamps it can have."""

    name: str
    matches: Callable[[Column], Column]
    normalize: Callable[[str, Masker], tuple[str, int | None]]
    families: tuple[Family, ...] = ()


def _json_time(value) -> int | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return int(value) if value >= 1e12 else int(value) * 1000 if value >= 1e9 else None
    if isinstance(value, str):
        for family in FAMILIES:
            if found := parse(value, family):
                return found[0]
        return parse_time_param(value)
    return None


def _json_class(value) -> str:
    if value is None:
        return "<NULL>"
    if isinstance(value, bool):
        return "<BOOL>"
    if isinstance(value, (int, float)):
        return "<NUM>"
    return "<STR>" if isinstance(value, str) else "<JSON>"


def normalize_json(line: str, mask: Masker) -> tuple[str, int | None]:
    try:
        record = json.loads(line)
    except ValueError:
        return mask(line), None
    if not isinstance(record, dict):
        return mask(line), None
    when = next((ms for k in TIME_KEYS if (ms := _json_time(record.get(k))) is not None), None)
    parts = [mask(v) if k in MESSAGE_KEYS and isinstance(v, str) else f"{k}={_json_class(v)}" for k, v in sorted(record.items()) if k not in TIME_KEYS]
    return " ".join(parts).rstrip() or "<EMPTY>", when


def normalize_cef(line: str, mask: Masker) -> tuple[str, int | None]:
    fields = [x.strip() for x in line.split("|")]
    fields += ["-"] * (8 - len(fields))
    return f"CEF {fields[1]} {fields[2]} {fields[4]} {fields[5]} {fields[6]} {mask(fields[7])}", None


def normalize_rfc5424(line: str, mask: Masker) -> tuple[str, int | None]:
    m = re.match(r"[^>]*>\s*\S+ (.*)", line, re.DOTALL)
    if not m:
        return mask(line), None
    words = split_tokens(m[1])
    _, _, app, process, message_id, *rest = (words + ["-"] * 5)[: max(5, len(words))]
    if rest[:1] == ["-"]:
        rest = rest[1:]
    elif rest and rest[0].startswith("["):
        closed = next((i for i, w in enumerate(rest) if "]" in w), len(rest) - 1)
        rest = rest[closed + 1 :]
    return f"RFC5424 <HOST> {app} {mask(process)} {mask(message_id)} {mask(' '.join(rest))}", None


def normalize_os_log(line: str, mask: Masker) -> tuple[str, int | None]:
    text = line.lstrip()
    found = parse(text, ISO)
    if not found:
        return mask(line), None
    level, body = "Default", []
    for i, word in enumerate(split_tokens(text.encode()[len(text[: found[1][1]].encode()) :].decode())):
        if word in OS_LEVELS:
            level = word
        elif not (HEX_ID.fullmatch(word) or re.fullmatch("[0-9]+", word) or (i == 0 and word in OS_TYPE_CODES)):
            body.append(word)
    return mask(f"OSLOG {level} {' '.join(body)}".rstrip() if body else f"OSLOG {level} "), None


def normalize_console(line: str, mask: Masker) -> tuple[str, int | None]:
    m = re.match(r"\s*\[([^\]]*)\]\s*([A-Za-z]*)[:\s]*(.*)", line, re.DOTALL)
    return (f"{m[1]} {m[2]} {mask(m[3])}", None) if m else (mask(line), None)


def normalize_logcat_brief(line: str, mask: Masker) -> tuple[str, int | None]:
    m = re.match(r"\s*(\S)/([^:(\s]*)[: ()0-9]*(.*)", line, re.DOTALL)
    return (f"{m[1]} {m[2]} {mask(m[3])}", None) if m else (mask(line), None)


def _os_log_matches(text: Column) -> Column:
    tail = F.regexp_extract(F.ltrim(text), f"(?s)^{ISO.java}(.*)$", len(ISO.groups) + 1)
    words = F.slice(F.filter(F.split(tail, r"\s+"), lambda w: w != ""), 1, 6)
    return F.exists(words, lambda w: w.rlike("^0[xX][0-9A-Fa-f]+$")) & F.exists(words, lambda w: w.isin(*OS_LEVELS))


#: In the order in which ties are decided.
FORMATS = (
    LogFormat("json", lambda t: t.rlike(r"(?s)^\s*\{.*\}\s*$"), normalize_json),
    LogFormat("cef", lambda t: t.rlike(r"^\s*CEF:"), normalize_cef),
    LogFormat("rfc5424", lambda t: t.rlike(r"^\s*<[0-9]{1,3}>[0-9]"), normalize_rfc5424, (ISO,)),
    LogFormat("os_log", _os_log_matches, normalize_os_log, (ISO,)),
    LogFormat("logcat_brief", lambda t: t.rlike(r"(?s)^\s*[VDIWEF]/."), normalize_logcat_brief),
    LogFormat("oslog_console", lambda t: t.rlike(rf"^\s*\[[^\]]*:[^\]]*\]\s*(?:{'|'.join(CONSOLE_LEVELS)})(?![0-9A-Za-z])"), normalize_console),
)
PLAIN = LogFormat("plain", lambda t: F.lit(True), lambda line, mask: (mask(line), None), FAMILIES)


def detect_format(sample: DataFrame, formats: tuple[LogFormat, ...] = FORMATS) -> LogFormat:
    """The format that most of the sampled ``text`` lines match, if it has enough; else plain."""
    counts = sample.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f.matches(F.col("text"))).alias(f"c{i}") for i, f in enumerate(formats)]).first()
    best = max(range(len(formats)), key=lambda i: (counts[f"c{i}"], -i), default=None)
    return formats[best] if best is not None and counts["n"] and counts[f"c{best}"] >= least_hits(counts["n"]) else PLAIN


def normalize_header_token(token: str) -> str:
    return token.strip("[]()<>\"'").rstrip(":,;")


def learn_header(sample: list[str]) -> tuple[str | None, ...]:
    """Masks to force on the first tokens of plain lines, learnt from sampled lines without their times.

    Positions count as long as four fifths of the lines have them and they are constant (a token on four fifths of the
    lines), of one dynamic class (three fifths) or out of a few values (eight make up 19 of 20). Only dynamic positions
    are forced; none at all gives no header. Among equally frequent classes the smaller name wins.
    """
    if len(sample) < 8:
        return ()
    rows, n, slots = [split_tokens(x) for x in sample], len(sample), []
    for at in range(8):
        here = [r[at] for r in rows if len(r) > at]
        if 10 * len(here) < 8 * n:
            break
        values = Counter(map(normalize_header_token, here))
        classes = Counter(c for c in map(classify_token, here) if c)
        name, most = min(classes.items(), key=lambda x: (-x[1], x[0]), default=(None, 0))
        if 10 * max(values.values()) >= 8 * n:
            slots.append(None)
        elif 10 * most >= 6 * n:
            slots.append(name)
        elif 100 * sum(c for _, c in values.most_common(8)) >= 95 * len(here):
            slots.append(None)
        else:
            break
    return tuple(slots) if any(slots) else ()


def normalized(df: DataFrame, fmt: LogFormat, header: tuple[str | None, ...] = (), config: MaskConfig = MaskConfig(), text_col: str = "text") -> DataFrame:
    """``df`` with ``content`` and ``field_ms``: Arrow batches of the text column alone go through Python, with the
    masks of tokens kept in a bounded table. Plain lines are masked by the distinct tokens of a batch."""
    if fmt is PLAIN:
        return df.withColumns({"content": masked_lines(F.col(text_col), header, config), "field_ms": F.lit(None).cast("bigint")})

    @F.pandas_udf("content string, field_ms bigint")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [(None, None) if t is None else fmt.normalize(t, lambda x: mask_line(x, header, config)) for t in texts]
            yield pd.DataFrame({"content": [r[0] for r in rows], "field_ms": pd.array([r[1] for r in rows], "Int64")})

    return df.withColumn("__n", convert(F.col(text_col))).select(*df.columns, F.col("__n.content").alias("content"), F.col("__n.field_ms").alias("field_ms"))
