import os

import pytest
from pyspark.sql import functions as F

from lumberline.functions.timefmt import CustomFormat, parse_time_param
from lumberline.operators import analysis, search, sequence
from lumberline.operators.ingest import open_log, refreshed
from lumberline.session import NO_LOG, SavedFilter, Session, Store, ToolError
from lumberline.sources.text import FileChange, FileState, forward_filled, ios_log, lines_from, read_lines
from lumberline.sources.versions import Conflict, LogFolder
from lumberline.streaming.tail import TailAnalysis, TailReader, check_change, tail


def write(path, lines, end="\n"):
    path.write_bytes(end.join(lines).encode() + (end.encode() if lines else b""))
    return str(path)


@pytest.fixture(scope="module")
def repetitive(spark, tmp_path_factory):
    lines = [f"2026-07-19T10:00:{i:02d}.000Z " + ("ERROR disk /dev/sda full" if i == 10 else f"INFO request completed in {i}ms") for i in range(21)]
    return write(tmp_path_factory.mktemp("logs") / "a.log", lines)


def test_lines_of_files(spark, tmp_path):
    a = write(tmp_path / "crlf.log", ["alpha", "beta"], "\r\n")
    (tmp_path / "open.log").write_text("one\ntwo\n\ngamma")
    (tmp_path / "empty.log").write_text("")
    assert [(r["line_no"], r["text"]) for r in read_lines(spark, a).orderBy("line_no").collect()] == [(0, "alpha"), (1, "beta")]
    assert [r["text"] for r in read_lines(spark, str(tmp_path / "open.log")).orderBy("line_no").collect()] == ["one", "two", "", "gamma"]
    assert read_lines(spark, str(tmp_path / "empty.log")).count() == 0
    two = read_lines(spark, [a, str(tmp_path / "open.log")])
    assert two.groupBy("doc_id").agg(F.max("line_no").alias("m")).select(F.sum("m")).first()[0] == 4


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = write(tmp_path / "big.log", [f"line {i} " + "x" * (i % 50) for i in range(20_000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = read_lines(spark, path)
        assert df.where(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" ")) != F.regexp_extract("text", "^line \\d+ ", 0)).count() == 0
        assert df.select("line_no").distinct().count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_times_are_carried_forward(spark):
    rows = [("d", i, 10 * i if i in (2, 5) else None) for i in range(9)]
    df = forward_filled(spark.createDataFrame(rows, "doc_id string, line_no bigint, ts_raw_ms bigint"), chunk=3)
    assert [r["ts_ms"] for r in df.orderBy("line_no").collect()] == [None, None, 20, 20, 20, 50, 50, 50, 50]


def test_session_over_a_file(spark, repetitive):
    s = Session(spark)
    info = s.load_log(repetitive)
    assert (info["lines"], info["template_count"], info["format"]) == (21, 2, "format: plain · date: ISO-8601")
    assert s.summarize_log() == NO_LOG
    seq = s.log_sequence(collapse=True, with_filtered_log=False)["entries"]
    assert [(e["line"], e["cnt"]) for e in seq] == [(1, 10), (11, 1), (12, 10)]
    summary = s.summarize_log(with_filtered_log=False)
    assert summary["top_templates"][0]["cnt"] == 20 and summary["error_lines"] == 1
    assert s.find_occurrences("ERROR")["results"][0]["line"] == 11
    s.add_filter("ERROR")
    assert s.raw_log(1, 21, with_filtered_log=True)["total"] == 1
    with pytest.raises(ToolError):
        s.add_filter("  ")
    hist = s.get_timeline_histogram(buckets=16, with_filtered_log=False)
    assert hist["domain"] == "time" and sum(b["cnt"] for b in hist["buckets"]) == 21
    assert s.trim(5, 8)["lines"] == 4 and s.trim()["lines"] == 21
    assert len(s.get_template_samples(1, 3, "first", with_filtered_log=False)["samples"]) == 3
    assert [p["pin_id"] for p in (s.save_pin([12], "b"), s.save_pin([2, 3], "a"))[-1]] == [2, 1]
    s.close_log("log_1")
    with pytest.raises(ToolError):
        s.stats()


def events(spark, texts, step=1000):
    return spark.createDataFrame([(i, step * i, t, len(t)) for i, t in enumerate(texts)], "line_no bigint, ts_ms bigint, text string, template_id int")


def test_lanes_and_filters(spark):
    lines = events(spark, [f"l{i}" + ("A" if i in (1, 3, 6) else "") + ("B" if i in (3, 4) else "") for i in range(8)])

    def shown(active, others):
        return [r["line_no"] for r in search.lanes(lines, ["A", "B"], active, others).orderBy("line_no").collect()]

    assert shown([False, False], True) == [0, 2, 5, 7]
    assert shown([True, False], False) == [1, 3, 6]
    assert len(shown([True, True], True)) == 8
    f = search.FilterSet(["x", "y"])
    assert not f.add("x") and f.remove(0) == "x" and f.keywords == ["y"]
    state = search.LaneState(f)
    state.toggle(None)
    state.remove(0)
    assert state.others


def test_ranges_and_windows(spark):
    lines = events(spark, ["err a", "err b", "err c"], 300_000)
    assert search.resolve_range(lines, 1, 99) == search.Range(0, 3)
    assert search.resolve_range(lines, "1970-01-01 00:04:00", None) == search.Range(1, 3)
    assert search.resolve_range(lines, "1971-01-01", None) == search.Range(2, 3)
    with pytest.raises(ValueError):
        search.resolve_range(lines, 3, 1)
    with pytest.raises(ValueError):
        search.resolve_range(lines, 0, 1)
    counts = [search.hit_summary(lines, "err", *w).first()["total"] for w in ((None, None), (300_000, None), (None, 300_000), (300_000, 300_000))]
    assert counts == [3, 2, 2, 1]
    assert analysis.time_gaps(lines).first()["gap_ms"] == 300_000
    assert search.find(lines, "ERR B", fold_case=True).count() == 1 and search.find(lines, " ").count() == 0


def test_neighbours_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(analysis, "CHUNK", 3)
    monkeypatch.setattr(sequence, "CHUNK", 3)
    lines = events(spark, ["a", "bb", "bb", "bb", "bb", "a", "a", "ccc"]).where("line_no <> 5")
    got = [(r["start_line"], r["end_line"], r["cnt"]) for r in sequence.runs(lines).orderBy("start_line").collect()]
    assert got == [(0, 0, 1), (1, 4, 4), (6, 6, 1), (7, 7, 1)]
    assert analysis.time_gaps(lines, 1).first().asDict() == {"line": 7, "gap_ms": 2000}


def test_anomalies(spark):
    n = 1000
    texts = ["alpha tick" if i % 2 else "beta tock!" for i in range(n)]
    texts[300] = "one unique trace line"
    texts[995] = "fatal"
    for i in range(940, 960):
        texts[i] = "warn disk almost full"
    found = {r["template_id"]: r["reasons"] for r in analysis.anomalies(events(spark, texts)).collect()}
    assert "rare" in found[len(texts[300])] or texts[300] in texts
    assert "first_seen_late" in found[5] and "bursty" in found[21] and 10 not in found


def test_samples_are_fixed():
    assert analysis.sample_ordinals(10, 3, "first") == [0, 1, 2]
    assert analysis.sample_ordinals(10, 4, "even") == [0, 3, 6, 9]
    one = analysis.sample_ordinals(1000, 5)
    assert one == analysis.sample_ordinals(1000, 5) and one[0] == 0 and one[-1] == 999 and len(one) == 5
    with pytest.raises(ValueError):
        analysis.sample_ordinals(10, 3, "other")


def test_highlights_and_words(spark):
    df = spark.createDataFrame([("disk error on /dev/sda error",)], "text string")
    spans = df.select(sequence.highlight_spans(F.col("text"), "error", "DISK", ["or o", "dev"]).alias("s")).first()["s"]
    assert [(x["start"], x["stop"], x["kind"]) for x in spans] == [(0, 4, "keyword"), (5, 10, "search"), (10, 12, "filter"), (15, 18, "filter"), (23, 28, "search")]
    spans = df.select(sequence.highlight_spans(F.col("text"), "rr", "error", ["sk error on"]).alias("s")).first()["s"]
    assert [(x["start"], x["stop"], x["kind"]) for x in spans] == [(2, 5, "filter"), (5, 6, "keyword"), (6, 8, "search"), (8, 10, "keyword"), (10, 13, "filter"), (23, 24, "keyword"), (24, 26, "search"), (26, 28, "keyword")]

    def word(text, at):
        return spark.createDataFrame([(text,)], "t string").select(sequence.keyword_at(F.col("t"), at)).first()[0]

    assert word("disk error on /dev/sda error", 16) == "/dev/sda"
    assert word("go (user=42;x.y:z) now", 6) == "user=42;x.y:z"
    assert word("long-term plan", 2) == "long" and word("long-term plan", 6) == "term" and word("long-term plan", 4) is None
    assert word("a\u00a0b", 1) is None and word("ab", 2) is None and word("", 0) is None


def test_durations_and_axis(spark):
    rows = [0, 999, 1000, 1049, 1050, 1150, 1250, 1350, 1750, 59_949, 59_950, 60_000, 61_000, 3_600_000, 3_660_000, 100_000_000, -5, 90_000, 5_400_000, 129_600_000]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, ms bigint")
    found = df.select("ms", sequence.format_delta_ms(F.col("ms")).alias("d"), sequence.format_human_ms(F.col("ms")).alias("h"), sequence.format_pin_ms(F.col("ms")).alias("p")).orderBy("i").collect()
    for r in found:
        ms = r["ms"]  # Python rounds the exact binary value too
        assert r["d"] == "Δ " + (f"{ms // 3_600_000}h {ms % 3_600_000 // 60_000}m" if ms >= 3_600_000 else f"{ms // 60_000}m {ms % 60_000 // 1000}s" if ms >= 60_000 else f"{ms / 1000:.1f}s" if ms >= 1000 else f"{ms}ms")
    human = {r["ms"]: r["h"] for r in found}
    assert [human[x] for x in (-5, 999, 1250, 60_000, 61_000, 3_600_000, 3_660_000)] == ["0ms", "999ms", "1.2sec", "1m", "1m 1sec", "1h", "1h 1m"]
    pin = {r["ms"]: r["p"] for r in found}
    assert [pin[x] for x in (-5, 1750, 90_000, 5_400_000, 129_600_000)] == ["-5 ms", "1.8 sec", "1.5 min", "1.5 hr", "1.5 days"]
    assert [t for _, t in sequence.axis_labels(0, 60_000)][:2] == ["00:00.000", "00:10.000"]
    assert sequence.axis_labels(0, 7_200_000)[-1] == (7_200_000, "02:00:00.000") and sequence.axis_labels(0, 90_000_000)[0][1] == "1970-01-01 00:00:00.000"
    assert sequence.axis_labels(1, 13, False)[1] == (3, "L3")
    assert sequence.effective_zoom((-5, 10), 0, 8) == (0, 8) and sequence.effective_zoom(None, 0, 8) == (0, 8)
    assert sequence.caption(5, False) == "~line 5" and sequence.caption(0) == "1970-01-01 00:00:00.000"


def told(reader, start, end):
    return [x.as_py() for p in reader.partitions(start, end) for b in reader.read(p) for x in b.column("text")]


@pytest.mark.parametrize("range_bytes", [1, 3, 1 << 20])
def test_tail(spark, tmp_path, range_bytes):
    path = tmp_path / "t.log"
    path.write_text("one\ntwo\n\r\npart")
    reader = TailReader(str(path), range_bytes)
    start, end = reader.initialOffset(), reader.latestOffset()
    assert told(reader, start, end) == ["one", "two", ""] and end["byte"] == 10
    assert len(reader.partitions(start, end)) == -(-10 // range_bytes) and reader.partitions(end, end) == []
    state = FileState.of(str(path))
    with path.open("a") as f:
        f.write("ial\nnext\n")
    assert check_change(str(path), state) is FileChange.APPENDED
    more = reader.latestOffset()
    assert told(reader, end, more) == ["partial", "next"]
    path.write_text(path.read_text().replace("two", "TWO") + "more\n")
    with pytest.raises(ValueError, match="modified in place"):
        reader.partitions(more, reader.latestOffset())
    path.write_text("x\n")
    with pytest.raises(ValueError, match="shrunk"):
        reader.partitions(more, reader.latestOffset())
    with pytest.raises(ValueError):
        check_change(str(path), state)
    path.write_text("y" * 200_000)
    assert reader.latestOffset()["byte"] == 0


def test_parts_of_a_file(spark, tmp_path):
    path = tmp_path / "p.log"
    lines = [f"line {i}" + "z" * (i % 13) for i in range(200)] + ["", "last"]
    path.write_bytes("\r\n".join(lines).encode())
    size, start = path.stat().st_size, len("\r\n".join(lines[:50])) + 2
    for range_bytes in (7, 64, 10**6):
        got = lines_from(spark, str(path), start, 50, size, "d", range_bytes).orderBy("line_no").collect()
        assert [(r["doc_id"], r["line_no"], r["text"], r["n_bytes"]) for r in got] == [("d", 50 + i, x, len(x)) for i, x in enumerate(lines[50:])]
    assert lines_from(spark, str(path), size, 9, size).count() == 0


def numbered(i, what):
    return f"2026-07-19 10:{i // 60:02d}:{i % 60:02d} {what}\n"


def test_tail_equals_one_load(spark, tmp_path):
    words = ["job {} done", "disk {} full", "user bob in", "user eve in", "", "net down {}"]
    lines = [numbered(i, words[(i * 7) % 6].format(i)) if i % 5 else f"  at frame {i}\n" for i in range(120)]
    path, whole = tmp_path / "s.log", tmp_path / "whole.log"
    whole.write_text("".join(lines))
    path.write_text("".join(lines[:40]))
    follower = TailAnalysis(spark, str(tmp_path / "log"), keep=2)

    def run(analysis):
        query = tail(spark, str(path), 200).writeStream.foreachBatch(analysis.batch).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    assert follower.log is None
    run(follower)
    early = follower.log
    for part in (lines[40:41], lines[41:90], lines[90:119], lines[119:]):
        with path.open("a") as f:
            f.write("".join(part))
        follower = TailAnalysis(spark, str(tmp_path / "log"), keep=2)  # a new driver, which knows the folder only
        run(follower)
    assert early.lines.count() == 40 and early.templates.agg(F.sum("count")).first()[0] == 40  # readers keep their version
    follower.batch(early.lines.limit(1), 0)  # a batch that comes again
    assert len(follower.versions.versions()) == 5
    once = open_log(spark, str(whole))
    got, want = ([(r["line_no"], r["ts_ms"], r["template_id"]) for r in log.lines.orderBy("line_no").collect()] for log in (follower.log, once))
    assert got == want
    got, want = ([(r["template_id"], r["pattern"], r["count"], r["example_line"]) for r in log.templates.orderBy("template_id").collect()] for log in (follower.log, once))
    assert got == want


def test_versions_of_a_log(spark, tmp_path, monkeypatch):
    path = tmp_path / "v.log"
    path.write_text("".join(numbered(i, f"job {i} done") for i in range(30)))
    folder = LogFolder(spark, str(tmp_path / "versions"))
    with pytest.raises(FileNotFoundError):
        folder.open()
    custom = (CustomFormat("own", r"(?P<year>\d+)/(?P<month>\d+)/(?P<day>\d+) (?P<hour>\d+):(?P<min>\d+):(?P<sec>\d+)"),)
    with folder.writing():
        log = open_log(spark, str(path), custom=custom)
    assert folder.commit(log, {"who": "me"}) == 1
    same = lambda x: sorted(tuple(r) for r in x.lines.collect()) + sorted(tuple(r) for r in x.templates.collect())
    again, note = LogFolder(spark, str(tmp_path / "versions")).open()
    assert note == {"who": "me"} and same(again) == same(log)
    assert (again.fmt, again.family, again.header, again.custom, again.config, again.state) == (log.fmt, log.family, log.header, custom, log.config, log.state)
    with path.open("a") as f:
        f.write(numbered(30, "disk 7 full"))
    with folder.writing():
        grown = refreshed(spark, again)
    with pytest.raises(Conflict):
        folder.commit(grown, after=0)
    assert folder.versions() == [1] and same(folder.open()[0]) == same(log)
    assert folder.commit(grown) == 2 and folder.open()[0].stored.count() == 31 and folder.open(1)[0].stored.count() == 30
    # an append that is killed while it writes leaves files, but no version
    before = same(folder.open()[0])
    with folder.writing():
        monkeypatch.setattr(LogFolder, "commit", lambda *_a, **_k: pytest.fail("killed"))
        refreshed(spark, folder.open(1)[0])
    assert folder.versions() == [1, 2] and same(folder.open()[0]) == before
    dropped = folder.clean(1)
    assert dropped and folder.versions() == [2] and same(folder.open()[0]) == before and folder.clean(1) == []


def test_refresh_of_a_session(spark, tmp_path):
    path = tmp_path / "r.log"
    path.write_text("".join(numbered(i, f"tick {i}") for i in range(30)))
    s = Session(spark)
    s.load_log(str(path))
    s.add_filter("boom")
    assert s.refresh()["change"] == "unchanged"
    with path.open("a") as f:
        f.write(numbered(30, "boom now") + "stack line\n")
    after = s.refresh()
    assert (after["change"], after["appended"], after["lines"]) == ("appended", 2, 32)
    assert s.find_occurrences("boom", with_filtered_log=True)["total"] == 1
    assert s.find_occurrences("stack")["results"][0]["line"] == 32
    path.write_text(path.read_text()[:-1] + "!")
    assert "modified" in s.refresh()["message"]
    path.write_text("x\n")
    assert "shrunk" in s.refresh()["message"]


def test_generators_and_store(spark, tmp_path):
    small, large = (ios_log(spark, n).orderBy("line_no").collect() for n in (50, 80))
    assert small == large[:50]
    store = Store(str(tmp_path / "home"))
    store.save_filter(SavedFilter("b", ("x",)))
    store.save_filter(SavedFilter("a", ("y", "z")))
    store.rename_filter("b", "c")
    assert store.list_filters() == ["a", "c"] and store.load_filter("a").keywords == ("y", "z")
    assert store.add_recent("p") == ["p"] and store.add_recent("q") == ["q", "p"] and store.add_recent("p") == ["p", "q"]
    assert not os.path.exists(tmp_path / "home" / "filters" / "b.json")


def test_custom_and_stack_traces(spark, tmp_path):
    path = write(tmp_path / "j.log", ["2026-07-19 10:00:00 start", "\tat com.app.Main(Main.java:10)", "2026-07-19 10:00:05 end"])
    log = open_log(spark, path)
    assert [r["ts_ms"] for r in log.lines.orderBy("line_no").collect()][1] == 1784455200000


def test_custom_times(spark, tmp_path):
    own = CustomFormat("own", r"(?P<day>\d+)\|(?P<month>\d+)\|(?<year>\d{4}) (?P<hour>\d+)h(?P<min>\d+)m(?P<sec>\d+)s(?:(?P<ms>\d+))?")
    lines = [f"{1 + i % 28}|7|2026 {i % 24}h{i % 60}m{i % 60}s{i} unit {'ok' if i % 2 else 'bad'}" for i in range(40)] + ["2026-07-19 10:00:00 other"] * 3 + ["31|2|2026 1h2m60s5 rolls", "1|13|2026 1h1m1s no", "1|1|2026 24h1m1s no", "1|1|2026 1h1m1s1000 no"]
    log = open_log(spark, write(tmp_path / "c.log", lines), custom=(own,))
    assert log.family is own
    rows = log.lines.orderBy("line_no").collect()
    for r, line in zip(rows, lines):
        try:
            found = own.extract(line)
        except ValueError:
            found = None
        assert r["ts_raw_ms"] == (found[0] if found else None), line
    assert own.extract("31|2|2026 1h2m60s5 x")[0] == own.extract("3|3|2026 1h3m0s5 x")[0]
    assert own.extract("1|1|2026 1h1m1s5 x")[0] % 1000 == 5
    assert own.describe("1|2|2026 3h4m5s6") == "Year: 2026, Month: 2, Date: 1, Hour: 3, Min: 4, Sec: 5, MILLI SECOND: 6"
    assert {r["pattern"] for r in log.templates.collect()} >= {"unit <*>"} or {r["pattern"] for r in log.templates.collect()} >= {"unit ok", "unit bad"}
    assert parse_time_param("2026-07-19T10:15:30") == parse_time_param("2026-07-19 10:15:30") == 1784456130000


def test_nearest_of_a_probe_that_occurs_again(spark):
    """As in the SQL, an id is one probe: of all its times, the line nearest to any."""
    lines = spark.createDataFrame([(1, 1_000), (2, 5_000), (3, None), (4, 9_000_000), (5, 9_000_000)], "line_no long, ts_ms long")
    probes = spark.createDataFrame([(7, 1_400), (7, 4_900), (7, 1_400), (8, 3_000), (9, 20_000_000), (9, None)], "probe_id long, probe_ms long")
    got = sorted(tuple(r) for r in sequence.nearest_each(probes, lines).collect())
    assert got == [(7, 5_000, 2), (8, 1_000, 1), (9, 9_000_000, 4)]


def test_nearest_by_frames_that_grow(spark):
    """A frame up to the end of a bucket is gone through anew for each of its rows."""
    lines = spark.createDataFrame([(i, 40 * i) for i in range(0, 3_000, 7)], "line_no long, ts_ms long")
    probes = spark.createDataFrame([(i, 33 * i) for i in range(500)], "probe_id long, probe_ms long")
    found = sequence.nearest_each(probes, lines, 5_000)
    assert "unboundedfollowing" not in found._jdf.queryExecution().analyzed().toString().lower()
    want = {i: min((abs(40 * n - 33 * i), 40 * n, n) for n in range(0, 3_000, 7))[1:] for i in range(500)}
    assert {r["probe_id"]: (r["ts_ms"], r["line_no"]) for r in found.collect()} == want
