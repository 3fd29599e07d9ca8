"""Masking of dynamic tokens: one table of shapes, read by a Python masker and by a native column expression."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes and the names that replace them. The patterns mean the same in Python and in Java.
URL = r"^.*://.*$"
EMAIL = r"^[^@]+@(?=.*\.).{3,}$"
JSON = r'^(?:\{.*:.*\}|\[.*".*\])$'
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
CLOCK = r"^[0-9]{1,2}(?:\.[0-9]+)?(?::[0-9]{1,2}(?:\.[0-9]+)?){1,2}$"
IPV4 = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?$"
IPV6 = r"^(?=(?:[^:]*:){2})[0-9A-Fa-f:]{6,}$"
PATH = r"^(?:/.*/.*|/(?=.*\.).{3,}|\\\\.{3,}|[A-Za-z]:\\.+)$"
DURATION = r"^(?=.*[0-9.])(?=.*[mshd])[0-9.mshd]+$"
NUMBER = r"^[+-]?(?=[^0-9]*[0-9])[0-9]*\.?[0-9]*$"
HEX = r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{8,64}$"
RUN_NUMBER = r"(?<![0-9A-Za-z])[0-9]+(?![0-9A-Za-z])"
RUN_HEX = r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{8,64}(?![0-9A-Za-z])"

#: (switch of MaskConfig, shape, replacement) in the order in which a whole token is tried ...
WHOLE = (
    ("urls", URL, "<URL>"),
    ("emails", EMAIL, "<EMAIL>"),
    ("json", JSON, "<JSON>"),
    ("uuid", UUID, "<UUID>"),
    ("times", CLOCK, "<TIME>"),
    ("ips", IPV4, "<IP>"),
    ("ips", IPV6, "<IPV6>"),
)
#: ... a bare value or the right side of key=value ...
VALUE = (("paths", PATH, "<PATH>"), ("times", DURATION, "<TIME>"), ("nums", NUMBER, "<NUM>"), ("hex", HEX, "<HEX>"))
#: ... and a header token is classified.
HEADER = ((URL, "<URL>"), (EMAIL, "<EMAIL>"), (UUID, "<UUID>"), (CLOCK, "<TIME>"), (IPV4, "<IP>"), (IPV6, "<IPV6>"), (DURATION, "<TIME>"), (NUMBER, "<NUM>"), (HEX, "<HEX>"), (PATH, "<PATH>"))

#: What each token that any shape or run changes has: a digit or a sign of these, or (a time, a UUID) only such letters.
MASKABLE = r"[0-9:@{\[/\\]|(?:^|=)[.mshd]+$|^[A-Fa-f]{8}-"

#: Unicode white space; Python's str.split would also split at U+001C to U+001F.
SPACE = r"[\u0009-\u000D \u0085   -     　]+"
_SPACE = re.compile(SPACE)
_COMPILED = {p: re.compile(p, re.DOTALL) for p in {*(x[1] for x in WHOLE + VALUE), *(x[0] for x in HEADER), RUN_NUMBER, RUN_HEX}}


@dataclass(frozen=True)
class MaskConfig:
    """Which rules apply."""

    ips: bool = True
    hex: bool = True
    uuid: bool = True
    urls: bool = True
    paths: bool = True
    emails: bool = True
    json: bool = True
    times: bool = True
    nums: bool = True


def split_tokens(line: str) -> list[str]:
    return [t for t in _SPACE.split(line) if t]


def _shape(token: str, table, config: MaskConfig) -> str | None:
    for switch, pattern, name in table:
        if getattr(config, switch) and _COMPILED[pattern].match(token) and not token.endswith("\n"):
            return name
    return None


def mask_runs(token: str, config: MaskConfig = MaskConfig()) -> str | None:
    """Numeric and hex runs between separators replaced; None if there are none."""
    out = token
    if config.nums:
        out = _COMPILED[RUN_NUMBER].sub("<NUM>", out)
    if config.hex:
        out = _COMPILED[RUN_HEX].sub("<HEX>", out)
    return None if out == token else out


@lru_cache(maxsize=65_536)
def mask_token(token: str, config: MaskConfig = MaskConfig()) -> str | None:
    """The masked token, or None to keep it."""
    if name := _shape(token, WHOLE, config):
        return name
    key, eq, value = token.partition("=")
    if eq:
        name = _shape(value, VALUE, config) if key and value else None
        return f"{key}={name}" if name else None
    return _shape(token, VALUE, config) or mask_runs(token, config)


def mask_line(line: str, header: tuple[str | None, ...] = (), config: MaskConfig = MaskConfig()) -> str:
    """The line with its dynamic tokens masked; unchanged, white space included, if there are none.

    ``header[i]`` forces a mask on the i-th token, which keeps its constant parts if it has dynamic runs inside.
    """
    tokens, changed = split_tokens(line), False
    for i, token in enumerate(tokens):
        forced = header[i] if i < len(header) else None
        new = (mask_runs(token, config) or forced) if forced else mask_token(token, config)
        if new is not None:
            tokens[i], changed = new, True
    return " ".join(tokens) if changed else line


#: Control characters that Arrow takes for white space, but tokens may hold.
_KEPT = re.compile("[\x1c-\x1f]")


def mask_lines(lines: pa.Array, header: tuple[str | None, ...] = (), config: MaskConfig = MaskConfig()) -> pa.Array:
    """``mask_line`` of each line (null stays null): the distinct tokens of all lines are masked once."""
    tokens = pc.utf8_split_whitespace(pc.fill_null(lines, ""))
    ends = tokens.offsets.to_numpy().astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    known = coded.dictionary
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_of = np.repeat(np.arange(len(lines)), np.diff(ends))
    there = (pc.binary_length(known).to_numpy(zero_copy_only=False) > 0)[code]  # empty ones stand beside white space at the ends of a line
    code, line_of = code[there], line_of[there]
    counts = np.bincount(line_of, minlength=len(lines))
    starts = np.r_[0, np.cumsum(counts)]
    names: list[str] = []  # what masks give, numbered after the tokens
    to = np.arange(len(known))
    likely = np.flatnonzero(pc.match_substring_regex(known, MASKABLE).to_numpy(zero_copy_only=False))
    for i, t in zip(likely.tolist(), known.take(pa.array(likely)).to_pylist()):
        if (masked := mask_token(t, config)) is not None:
            to[i] = len(known) + len(names)
            names.append(masked)
    plain, code = code, to[code]
    changed = code >= len(known)
    for at, forced in enumerate(header):
        if forced:
            places = starts[:-1][counts > at] + at
            own: dict[int, int] = {}
            for c in set(plain[places].tolist()):
                own[c] = len(known) + len(names)
                names.append(mask_runs(known[c].as_py(), config) or forced)
            code[places] = [own[c] for c in plain[places].tolist()]
            changed[places] = True
    touched = np.zeros(len(lines), bool)
    touched[line_of[changed]] = True
    words = pa.concat_arrays([known, pa.array(names, known.type)]).take(pa.array(code))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words), " ")
    out = pc.if_else(pa.array(touched), texts, lines)
    if odd := np.flatnonzero(pc.match_substring_regex(pc.fill_null(lines, ""), _KEPT.pattern).to_numpy(zero_copy_only=False)).tolist():
        values = out.to_pylist()
        for i in odd:
            values[i] = mask_line(lines[i].as_py(), header, config)
        out = pa.array(values, pa.string())
    return out


def masked_lines(text: Column, header: tuple[str | None, ...] = (), config: MaskConfig = MaskConfig()) -> Column:
    """``mask_line`` of a column, by Arrow batches."""

    @F.arrow_udf("string")
    def masked_batch(lines: pa.Array) -> pa.Array:
        return mask_lines(lines, header, config)

    return masked_batch(text)


def classify_token(token: str) -> str | None:
    """The mask class of a header token."""
    for pattern, name in HEADER:
        if _COMPILED[pattern].match(token):
            return name
    runs = sorted((m.start(), name) for p, name in ((RUN_NUMBER, "<NUM>"), (RUN_HEX, "<HEX>")) for m in [_COMPILED[p].search(token)] if m)
    return runs[0][1] if runs else None


def _case(token: Column, table, config: MaskConfig, otherwise: Column | None) -> Column:
    out = None
    for switch, pattern, name in table:
        if getattr(config, switch):
            test = token.rlike(f"(?s){pattern}")
            out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    if out is None:
        return otherwise if otherwise is not None else F.lit(None)
    return out.otherwise(otherwise) if otherwise is not None else out


def token_class(token: Column, config: MaskConfig = MaskConfig()) -> Column:
    """The class of a whole token as a native expression (null: kept or masked in part)."""
    return _case(token, WHOLE + VALUE, config, None)


def masked_token(token: Column, config: MaskConfig = MaskConfig()) -> Column:
    """``mask_token`` as a native expression; tokens to keep come back as they are."""
    runs = token
    if config.nums:
        runs = F.regexp_replace(runs, RUN_NUMBER, "<NUM>")
    if config.hex:
        runs = F.regexp_replace(runs, RUN_HEX, "<HEX>")
    key, value = F.regexp_extract(token, "(?s)^([^=]+)=(.+)$", 1), F.regexp_extract(token, "(?s)^([^=]+)=(.+)$", 2)
    named = _case(value, VALUE, config, None)
    pair = F.when((key != "") & named.isNotNull(), F.concat(key, F.lit("="), named)).otherwise(token)
    rest = F.when(F.instr(token, "=") > 0, pair).otherwise(_case(token, VALUE, config, runs))
    return _case(token, WHOLE, config, rest)


def tokens_of(text: Column) -> Column:
    """The tokens between Unicode white space, as an array."""
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def masked(text: Column, config: MaskConfig = MaskConfig()) -> Column:
    """``mask_line`` without a header as a native expression, inside whole-stage plans without Python."""
    tokens = tokens_of(text)
    new = F.transform(tokens, lambda t: masked_token(t, config))
    return F.when(new == tokens, text).otherwise(F.array_join(new, " "))
