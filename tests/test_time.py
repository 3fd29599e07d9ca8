from datetime import date

import pytest
from pyspark.sql import functions as F

from lumberline.functions.timefmt import BY_NAME, CustomFormat, detect_family, epoch_ms, format_ms, parse, parse_time_param

NOW = date(2026, 8, 20)
CASES = [
    ("ISO-8601", "2026-08-15T19:40:01Z x", "2026-08-15 19:40:01.000"),
    ("ISO-8601", "at 2026-08-15 19:40:01,1234 +06:00 x", "2026-08-15 13:40:01.123"),
    ("ISO-8601", "2026-02-30T00:00:00Z", None),
    ("YYYY/MM/DD", "2021/03/09 04:17:58 [crit]", "2021-03-09 04:17:58.000"),
    ("MM/DD/YYYY", "7/5/2024 01:02:03.5 x", "2024-07-05 01:02:03.500"),
    ("DD-MM-YYYY", "31-12-2024 01:02:03", "2024-12-31 01:02:03.000"),
    ("MM-DD-YYYY", "31-12-2024 01:02:03", None),
    ("DD.MM.YYYY", "1.2.2024 01:02:03", "2024-02-01 01:02:03.000"),
    ("YYYY.MM.DD", "2024.2.1 01:02:03", "2024-02-01 01:02:03.000"),
    ("BSD syslog", "Mar  8 21:09:47 attic crond[6]: ran", "2026-03-08 21:09:47.000"),
    ("BSD syslog", "Nov 28 05:31:02 attic", "2025-11-28 05:31:02.000"),
    ("Apache CLF", '198.51.100.4 - - [23/Jun/2022:18:07:09 +0200] "PUT /cart"', "2022-06-23 16:07:09.000"),
    ("epoch", "1752000000123 x", "2025-07-08 18:40:00.123"),
    ("epoch", "1752000000 x", "2025-07-08 18:40:00.000"),
    ("epoch", "17520000001 x", None),
    ("logcat threadtime", "02-27 06:41:18.905   814   977 W Modem: x", "2026-02-27 06:41:18.905"),
    ("glog", "W0412 17:26:50.204811   311 shelf.cc:9] moved", "2026-04-12 17:26:50.204"),
    ("ISO-8601 12h AM/PM", "2025-09-02 7:48:33\u202fPM x", "2025-09-02 19:48:33.000"),
    ("ISO-8601 12h AM/PM", "2025-09-02 12:48:33 am", "2025-09-02 00:48:33.000"),
    ("RFC 2822", "sent Tue, 14 Apr 2026 23:40:05 -0330 by post", "2026-04-15 03:10:05.000"),
    ("RFC 2822", "sent Wed, 14 Apr 2026 23:40:05 -0330 by post", None),
    ("ISO-8601", "x" * 90 + "2026-08-15T19:40:01Z", None),
    ("ISO-8601", "no time", None),
]


def test_both_forms(spark):
    for name, line, want in CASES:
        found = parse(line, BY_NAME[name], NOW)
        assert (format_ms(found[0]) if found else None) == want, (name, line)
    for name in {c[0] for c in CASES}:
        mine = [(c[1], c[2]) for c in CASES if c[0] == name]
        df = spark.createDataFrame(mine, "line string, want string").select("line", "want", epoch_ms(F.col("line"), BY_NAME[name], NOW).alias("ms"))
        for r in df.collect():
            assert (None if r["ms"] is None else format_ms(r["ms"])) == r["want"], (name, r["line"])


def test_control_characters_make_no_time(spark):
    """A pattern's groups travel between control characters; lines that hold these have the time that they show."""
    lines = ["\u0001\u0002\u00012026-08-15T19:40:01Z", "\u0002\u00012026\u000108\u000115\u000119\u000140\u000101", "\u0002"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select(epoch_ms(F.col("line"), BY_NAME["ISO-8601"], NOW).alias("ms")).collect()
    assert [r["ms"] and format_ms(r["ms"]) for r in rows] == ["2026-08-15 19:40:01.000", None, None]


def test_few_lines_are_recognised_like_many(spark):
    from lumberline.operators.ingest import detect_time, time_family

    own = CustomFormat("own", r"<(?<day>\d+)-(?<month>\d+)-(?<year>\d+) (?<hour>\d+):(?<min>\d+):(?<sec>\d+)>")
    families = tuple(BY_NAME.values())
    for name in {c[0] for c in CASES}:
        for lines in ([c[1] for c in CASES if c[0] == name], [c[1] for c in CASES if c[0] == name and c[2]] * 3):
            df = spark.createDataFrame([(x,) for x in lines], "text string")
            assert time_family(lines, families, (own,), NOW) == detect_time(df, families, (own,), NOW)
    texts = ["<04-03-2026 10:00:00> a", "<04-13-2026 10:00:00> a", "b"] * 3
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    assert time_family(texts, families, (own,), NOW) == detect_time(df, families, (own,), NOW) and time_family([], families, ()) is None


def test_detection_prefers_the_earlier_family(spark):
    df = spark.createDataFrame([("03-04-2024 01:02:03 x",)] * 5, "text string")
    assert detect_family(df).name == "MM-DD-YYYY"
    assert detect_family(spark.createDataFrame([("nothing",)] * 5, "text string")) is None


def test_time_parameters():
    assert parse_time_param(5) == 5
    assert parse_time_param("1752000000") == 1752000000000
    assert parse_time_param("1752000000123") == 1752000000123
    assert parse_time_param("2026-08-15T19:40:01+02:00") == parse_time_param("2026-08-15 17:40:01")
    assert parse_time_param("2026-08-15") % 86_400_000 == 0
    assert parse_time_param("10:31") is None


def test_custom_format(spark):
    f = CustomFormat("own", r"(?<day>\d+)\|(?<month>\d+)\|(?<year>\d+) (?<hour>\d+):(?<min>\d+):(?<sec>\d+) ?(?<ampm>[ap]m)?")
    assert f.preview("5|7|2024 1:02:03 pm") == "2024-07-05 13:02:03.000"
    ms = spark.createDataFrame([("5|7|2024 1:02:03 pm",), ("5|13|2024 1:02:03 pm",), ("x",)], "t string").select(f.column(F.col("t")).alias("m")).collect()
    assert [r["m"] and format_ms(r["m"]) for r in ms] == ["2024-07-05 13:02:03.000", None, None]
    with pytest.raises(ValueError):
        CustomFormat("bad", r"(?<day>\d+)").compiled()
    with pytest.raises(ValueError):
        f.extract("5|7|2024 13:02:03 pm")
