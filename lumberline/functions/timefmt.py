"""Timestamp families: where a line has its time, and what it is in epoch milliseconds (UTC).

A family is a pattern with named groups. One native expression turns the groups into milliseconds for all families, so
parsing stays in the JVM; the same groups serve the driver-side parser for samples and user formats.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_BYTES = 96
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


@dataclass(frozen=True)
class Family:
    """``pattern`` has groups out of Y M D h m s f z ap mon dow epoch; yearless families lack Y."""

    name: str
    pattern: str

    @property
    def groups(self) -> dict[str, int]:
        return dict(re.compile(self.pattern).groupindex)

    @property
    def java(self) -> str:
        return re.sub(r"\(\?P<(\w+)>", "(", self.pattern)


# The families' names, order and patterns.
CLOCK = r"(?P<h>[0-9]{2}):(?P<m>[0-9]{2}):(?P<s>[0-9]{2})"
FRACTION = r"(?:[.,](?P<f>[0-9]+))?"
FAMILIES = (
    Family("ISO-8601", rf"(?P<Y>[0-9]{{4}})-(?P<M>[0-9]{{2}})-(?P<D>[0-9]{{2}})[T ]{CLOCK}{FRACTION}(?:\s?(?P<z>Z|[+-][0-9]{{2}}:?[0-9]{{2}}))?"),
    Family("YYYY/MM/DD", rf"^(?P<Y>[0-9]{{4}})/(?P<M>[0-9]{{2}})/(?P<D>[0-9]{{2}})[ T]{CLOCK}{FRACTION}"),
    Family("MM/DD/YYYY", rf"^\s*(?P<M>[0-9]{{1,2}})/(?P<D>[0-9]{{1,2}})/(?P<Y>[0-9]{{4}})[ T]{CLOCK}{FRACTION}"),
    Family("MM-DD-YYYY", rf"^\s*(?P<M>[0-9]{{1,2}})-(?P<D>[0-9]{{1,2}})-(?P<Y>[0-9]{{4}})[ T]{CLOCK}{FRACTION}"),
    Family("DD-MM-YYYY", rf"^\s*(?P<D>[0-9]{{1,2}})-(?P<M>[0-9]{{1,2}})-(?P<Y>[0-9]{{4}})[ T]{CLOCK}{FRACTION}"),
    Family("DD.MM.YYYY", rf"^\s*(?P<D>[0-9]{{1,2}})\.(?P<M>[0-9]{{1,2}})\.(?P<Y>[0-9]{{4}})[ T]{CLOCK}{FRACTION}"),
    Family("YYYY.MM.DD", rf"^\s*(?P<Y>[0-9]{{4}})\.(?P<M>[0-9]{{1,2}})\.(?P<D>[0-9]{{1,2}})[ T]{CLOCK}{FRACTION}"),
    Family("BSD syslog", rf"^(?P<mon>[A-Z][a-z]{{2}})\s{{1,2}}(?P<D>[0-9]{{1,2}})\s{CLOCK}"),
    Family("Apache CLF", rf"(?P<D>[0-9]{{2}})/(?P<mon>[A-Za-z]{{3}})/(?P<Y>[0-9]{{4}}):{CLOCK}\s(?P<z>[+-][0-9]{{4}})"),
    Family("epoch", r"^\s*(?P<epoch>[0-9]{13}|[0-9]{10})[\s,|\]]"),
    Family("logcat threadtime", r"^(?P<M>[0-9]{2})-(?P<D>[0-9]{2})\s(?P<h>[0-9]{2}):(?P<m>[0-9]{2}):(?P<s>[0-9]{2})\.(?P<f>[0-9]{3})"),
    Family("glog", rf"^[IWEF](?P<M>[0-9]{{2}})(?P<D>[0-9]{{2}})\s{CLOCK}(?:\.(?P<f>[0-9]+))?"),
    Family("ISO-8601 12h AM/PM", rf"(?P<Y>[0-9]{{4}})-(?P<M>[0-9]{{2}})-(?P<D>[0-9]{{2}})[T ](?P<h>[0-9]{{1,2}}):(?P<m>[0-9]{{2}}):(?P<s>[0-9]{{2}}){FRACTION}[\s  ]?(?P<ap>[aApP])[mM]"),
    Family("RFC 2822", rf"(?P<dow>[A-Za-z]{{3}}),?\s+(?P<D>[0-9]{{1,2}})\s+(?P<mon>[A-Za-z]{{3}})\s+(?P<Y>[0-9]{{4}})\s+{CLOCK}\s+(?P<z>[+-][0-9]{{4}}|GMT|UTC)"),
)
BY_NAME = {f.name: f for f in FAMILIES}


def search_window(text: Column) -> Column:
    """The first 96 bytes, cut at a character."""
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, WINDOW_BYTES).cast("string"))
    cut = F.regexp_replace(head, "\ufffd+$", "")
    return F.when(F.octet_length(text) <= WINDOW_BYTES, text).otherwise(cut)


def _whole(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def epoch_ms(text: Column, family: Family, now: date | None = None) -> Column:
    """Epoch milliseconds of the family's first match in the line's first 96 characters; null if there is none or the
    parts are no valid date. Fractions beyond milliseconds are cut off. Yearless families take the year of ``now``, or
    the year before if that lies more than a day ahead."""
    return F.get(F.transform(F.array(_groups(text, family)), lambda g: _millis_of(g, family, now)), F.lit(0))


#: Characters between and before the groups of a match; those of a line are put aside by another control character.
_CUT, _FOUND, _ASIDE = "\u0001", "\u0002", "\u0003"


def _groups(text: Column, family: Family) -> Column:
    """The groups of the family's first match, behind a mark; the pattern runs once for a line."""
    clean = F.translate(search_window(text), _CUT + _FOUND, _ASIDE * 2)
    whole = _CUT.join([_FOUND, *(f"${i}" for i in range(1, len(family.groups) + 1))])
    return F.split(F.regexp_replace(clean, f"(?s)^.*?(?:{family.java}).*$", whole), _CUT)


def _millis_of(groups: Column, family: Family, now: date | None) -> Column:
    at = family.groups

    def part(name: str) -> Column:
        return F.coalesce(F.get(groups, F.lit(at[name])), F.lit("")) if name in at else F.lit("")

    if "epoch" in at:
        digits = part("epoch")
        value = digits.try_cast("bigint")  # no digits without a match
        return F.when((F.length(digits) == 13) & value.between(10**12, 5 * 10**12 - 1), value).when((F.length(digits) == 10) & value.between(10**9, 5 * 10**9 - 1), value * 1000)
    month = _whole(part("M"))
    if "mon" in at:
        named = F.lower(part("mon"))
        month = F.coalesce(*[F.when(named == m, F.lit(i + 1)) for i, m in enumerate(MONTHS)])
    hour = _whole(part("h"))
    if "ap" in at:
        hour = F.when(hour.between(1, 12), hour % 12 + F.when(F.lower(part("ap")) == "p", 12).otherwise(0))
    millis = F.rpad(F.substring(part("f"), 1, 3), 3, "0").cast("int") if "f" in at else F.lit(0)
    zone = part("z")
    digits = F.regexp_replace(zone, "[^0-9]", "")
    offset = F.when(F.length(digits) == 4, (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0) * 60_000

    def with_year(year: Column) -> Column:
        return F.unix_millis(F.try_make_timestamp(year, month, _whole(part("D")), hour, _whole(part("m")), _whole(part("s")).cast("decimal(8,6)"), F.lit("UTC"))) + F.coalesce(millis, F.lit(0)) - offset

    if "Y" in at:
        out = with_year(_whole(part("Y")))
    else:
        today = now or datetime.now(UTC).date()
        limit = int(datetime(today.year, today.month, today.day, tzinfo=UTC).timestamp() * 1000) + 2 * 86_400_000
        this = with_year(F.lit(today.year))
        out = F.when(this > limit, with_year(F.lit(today.year - 1))).otherwise(F.coalesce(this, with_year(F.lit(today.year - 1))))
    if "dow" in at:
        local = F.timestamp_millis(out + offset)
        out = F.when(F.lower(F.date_format(local, "EEE")) == F.lower(part("dow")), out)
    return F.when(F.get(groups, F.lit(0)) == _FOUND, out).cast("bigint")


def without_time(text: Column, family: Family) -> Column:
    """The line with the family's first match cut out, if it starts within the search window."""
    if family.pattern.startswith("^"):
        return F.regexp_replace(text, family.java, "")
    return F.regexp_replace(text, f"(?s)^(.{{0,{WINDOW_BYTES}}}?)(?:{family.java})", "$1")


def parse(text: str, family: Family, now: date | None = None) -> tuple[int, tuple[int, int]] | None:
    """(epoch ms, span) of one line, on the driver."""
    head = text.encode()[:WINDOW_BYTES].decode("utf-8", "ignore")
    found = re.search(family.pattern, head)
    if not found:
        return None
    ms = _millis(found.groupdict(), now)
    return None if ms is None else (ms, found.span())


def _millis(g: dict[str, str | None], now: date | None) -> int | None:
    if g.get("epoch"):
        n = int(g["epoch"])
        return n if 10**12 <= n < 5 * 10**12 else n * 1000 if 10**9 <= n < 5 * 10**9 else None
    try:
        month = MONTHS.index(g["mon"].lower()) + 1 if g.get("mon") else int(g["M"])
        hour = int(g["h"])
        if g.get("ap"):
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + 12 * (g["ap"].lower() == "p")
        zone = g.get("z") or ""
        digits = re.sub("[^0-9]", "", zone)
        offset = (int(digits[:2]) * 60 + int(digits[2:])) * (-1 if zone[0] == "-" else 1) if len(digits) == 4 else 0
        today = now or datetime.now(UTC).date()

        def at(year: int) -> datetime:
            return datetime(year, month, int(g["D"]), hour, int(g["m"]), int(g["s"]), tzinfo=timezone(timedelta(minutes=offset)))

        when = at(int(g["Y"])) if g.get("Y") else at(today.year)
        if not g.get("Y") and when.date() > today + timedelta(days=1):
            when = at(today.year - 1)
        if g.get("dow") and when.strftime("%a").lower() != g["dow"].lower():
            return None
    except (ValueError, KeyError, AttributeError):
        return None
    return int(when.timestamp()) * 1000 + int(((g.get("f") or "") + "000")[:3])


@dataclass(frozen=True)
class CustomFormat:
    """A user's pattern with named groups year month day hour min sec [ms] [ampm]; ``(?P<name>`` and ``(?<name>`` both."""

    name: str
    pattern: str

    REQUIRED = ("year", "month", "day", "hour", "min", "sec")

    def compiled(self) -> re.Pattern:
        """The pattern; raises ``ValueError`` if it doesn't compile or lacks a group."""
        try:
            found = re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", self.pattern))
        except re.error as e:
            raise ValueError(f"invalid pattern: {e}") from e
        if missing := [g for g in self.REQUIRED if g not in found.groupindex]:
            raise ValueError(f"missing named groups: {', '.join(missing)}")
        return found

    def components(self, line: str) -> tuple[dict[str, int], tuple[int, int]] | None:
        """(year, month, day, hour of 24, min, sec, ms; span); None without a match; ``ValueError`` for values out of
        range. Numbers are read as they stand: ``ms`` "5" is 5 milliseconds."""
        m = self.compiled().search(line.encode()[:WINDOW_BYTES].decode("utf-8", "ignore"))
        if not m:
            return None
        g = m.groupdict()
        out = {}
        for name in (*self.REQUIRED, "ms"):
            text = (g.get(name) or "").strip()
            if re.fullmatch(r"[+-]?[0-9]+", text):
                out[name] = int(text)
            elif name == "ms":
                out[name] = 0
            else:
                raise ValueError(f"missing required group '{name}'")
        if not (1 <= out["month"] <= 12 and 1 <= out["day"] <= 31 and 0 <= out["min"] <= 59 and 0 <= out["sec"] <= 60 and 0 <= out["ms"] <= 999):
            raise ValueError("out of range: month 1-12, day 1-31, min 0-59, sec 0-60, ms 0-999")
        if g.get("ampm") is not None:
            ampm = g["ampm"].strip().lower()
            if ampm not in ("am", "pm"):
                raise ValueError("group 'ampm' must be AM or PM")
            if not 1 <= out["hour"] <= 12:
                raise ValueError("with 'ampm' the hour must be 1-12")
            out["hour"] = out["hour"] % 12 + 12 * (ampm == "pm")
        elif not 0 <= out["hour"] <= 23:
            raise ValueError("the hour must be 0-23, or needs a group 'ampm'")
        return out, m.span()

    def extract(self, line: str) -> tuple[int, tuple[int, int]] | None:
        """(epoch ms, span) of the line's first match; a day beyond its month's end runs into the next."""
        found = self.components(line)
        if not found:
            return None
        c, span = found
        first = (datetime(c["year"], c["month"], 1) - datetime(1970, 1, 1)).days
        return ((((first + c["day"] - 1) * 24 + c["hour"]) * 60 + c["min"]) * 60 + c["sec"]) * 1000 + c["ms"], span

    def describe(self, line: str) -> str:
        """The parts that the format reads from a sample line, one by one."""
        found = self.components(line)
        if not found:
            return "no match"
        c = found[0]
        # Fixed value: the labels and their order.
        return f"Year: {c['year']}, Month: {c['month']}, Date: {c['day']}, Hour: {c['hour']}, Min: {c['min']}, Sec: {c['sec']}, MILLI SECOND: {c['ms']}"

    def preview(self, line: str) -> str:
        """What the format makes of a sample line, as text."""
        found = self.extract(line)
        return format_ms(found[0]) if found else "no match"

    @property
    def java(self) -> str:
        return re.sub(r"\(\?P?<([A-Za-z]\w*)>", "(", self.pattern)

    def column(self, text: Column) -> Column:
        """The format as a native expression (null without a match or with values out of range)."""
        groups, java, head = self.compiled().groupindex, self.java, search_window(text)

        def part(name: str) -> Column:
            return F.trim(F.regexp_extract(head, java, groups[name]))

        year, month, day, hour, minute, sec = (_whole(part(name)) for name in self.REQUIRED)
        if "ampm" in groups:
            ap = F.lower(part("ampm"))
            of_12 = F.when(hour.between(1, 12) & ap.isin("am", "pm"), hour % 12 + F.when(ap == "pm", 12).otherwise(0))
            hour = F.when(ap == "", F.when(hour.between(0, 23), hour)).otherwise(of_12)
        else:
            hour = F.when(hour.between(0, 23), hour)
        ms = F.coalesce(part("ms").try_cast("int"), F.lit(0)) if "ms" in groups else F.lit(0)
        first = F.unix_date(F.when(month.between(1, 12) & year.between(1, 9999), F.make_date(F.greatest(F.least(year, F.lit(9999)), F.lit(1)), F.greatest(F.least(month, F.lit(12)), F.lit(1)), F.lit(1)))).cast("bigint")
        valid = day.between(1, 31) & minute.between(0, 59) & sec.between(0, 60) & ms.between(0, 999)
        return F.when(valid, ((((first + day - 1) * 24 + hour) * 60 + minute) * 60 + sec) * 1000 + ms).cast("bigint")

    def without(self, text: Column) -> Column:
        """The line with the first match cut out, if it starts within the search window."""
        if self.pattern.startswith("^"):
            return F.regexp_replace(text, self.java, "")
        return F.regexp_replace(text, f"(?s)^(.{{0,{WINDOW_BYTES}}}?)(?:{self.java})", "$1")


def least_hits(n: int) -> int:
    """How many of ``n`` sampled lines must match."""
    return min(n, max(n // 4, 2))


def detect_family(sample: DataFrame, families: tuple[Family, ...] = FAMILIES, now: date | None = None) -> Family | None:
    """The family that most of the sampled ``text`` lines have; the earlier of equals. One row comes to the driver."""
    counts = sample.agg(F.count(F.lit(1)).alias("n"), *[F.count(epoch_ms(F.col("text"), f, now)).alias(f"c{i}") for i, f in enumerate(families)]).first()
    best = max(range(len(families)), key=lambda i: (counts[f"c{i}"], -i), default=None)
    return families[best] if best is not None and counts["n"] and counts[f"c{best}"] >= least_hits(counts["n"]) else None


def parse_time_param(value: str | int) -> int | None:
    """A time argument in epoch ms: numbers are ms; texts are whole seconds (up to 11 characters) or ms, RFC 3339,
    ``Y-m-d H:M:S[.f]`` (also with a ``T``) or ``Y-m-d``."""
    if isinstance(value, int):
        return value
    text = value.strip()
    if re.fullmatch(r"[+-]?[0-9]+", text):
        return int(text) * (1000 if len(text) <= 11 else 1)
    if not re.search(r"(Z|[+-][0-9]{2}:[0-9]{2})$", text, re.I):
        text = text.replace("T", " ")  # without a zone
    else:
        text = re.sub("^([0-9-]{10})[ t]", r"\1T", re.sub("z$", "Z", text))
    for shape in ("%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            when = datetime.strptime(re.sub(r"(\.[0-9]{6})[0-9]+", r"\1", text), shape)
        except ValueError:
            continue
        when = when if when.tzinfo else when.replace(tzinfo=UTC)
        return (when - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)
    return None


def format_ms(ms: int) -> str:
    when = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=ms)
    return when.strftime("%Y-%m-%d %H:%M:%S.") + f"{when.microsecond // 1000:03d}"


def format_ms_column(ms: Column) -> Column:
    """``format_ms`` as a native expression (session time zone UTC)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")


def number_to_ms(number: Column) -> Column:
    """A JSON number that stands for a time: ms, seconds, or nothing."""
    n = number.cast("bigint")
    return F.when(number >= 1e12, n).when(number >= 1e9, n * 1000)
