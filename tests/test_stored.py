"""Stored logs, time counts and match bitmaps: the same as scans, and what they read."""

import random

import pytest
from pyspark.sql import functions as F

from lumberline.operators import analysis, bitmaps, search
from lumberline.operators.timecounts import TimeCounts
from lumberline.sources import stored as module
from lumberline.sources.stored import completed, store, stored

N = 1_000


@pytest.fixture
def uncoalesced(spark):
    """Small tables would be written as one file."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def small_chunks(monkeypatch, uncoalesced):
    monkeypatch.setattr(module, "CHUNK", 64)


def log_of(spark, times, seed=0):
    rng = random.Random(seed)
    rows = [("d", i, t, rng.choice(["error here", "all fine", "user=4 in", "user=41 error", ""])) for i, t in enumerate(times)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id string, line_no bigint, ts_ms bigint, text string").repartition(5)


def rows_scanned(df):
    """Rows that the scans of a plan gave, after it has run."""
    df.collect()
    plan, found, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "Scan" in node.nodeName() and node.metrics().contains("numOutputRows"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_ranges_read_their_chunks_only(spark, small_chunks):
    log = stored(log_of(spark, range(N)))
    assert log.count() == N and log.chunks.count() == -(-N // 64)
    files = len(log.lines.inputFiles())
    part = log.range(130, 150)
    assert [r["line_no"] for r in part.orderBy("line_no").collect()] == list(range(130, 150))
    assert len(part.inputFiles()) == 1 < files
    assert rows_scanned(part) <= 2 * 64  # a file holds more chunks than these, in row groups of their own
    assert sorted(r["line_no"] for r in log.at([0, 64, 999]).collect()) == [0, 64, 999] and log.at([]).count() == 0
    assert log.range(5, 5).count() == 0 and log.range(N, N + 9).count() == 0
    with pytest.raises(ValueError):
        log.at(list(range(2001)))


@pytest.mark.parametrize("seed", range(4))
def test_places_of_times_like_scans(spark, small_chunks, seed):
    rng = random.Random(seed)
    times = [None if rng.random() < 0.2 else rng.randrange(500) for _ in range(300)] if seed % 2 else [None] * 70 + sorted(rng.randrange(500) for _ in range(230))
    log = stored(log_of(spark, times))
    for t in (-5, 0, 100, 250, 499, 500, 900):
        after = [i for i, x in enumerate(times) if x is not None and x >= t]
        before = [i for i, x in enumerate(times) if (-1 if x is None else x) <= t]
        assert log.first_at_or_after(t) == (after[0] if after else None)
        assert log.last_at_or_before(t) == (before[-1] if before else None)
    for line in (0, 63, 64, 200, 299):
        assert log.first_time_at_or_after(line) == next((x for x in times[line:] if x is not None), None)
    assert log.last_time() == times[-1] and stored(log_of(spark, [])).count() == 0
    assert stored(log_of(spark, [])).first_at_or_after(0) is None


def test_lines_are_completed_in_one_shuffle(spark, small_chunks):
    rng = random.Random(1)
    raw = [rng.randrange(99) if rng.random() < 0.05 else None for _ in range(400)]
    lines = spark.createDataFrame([(d, i, t, f"x{i}") for d in "ab" for i, t in enumerate(raw)], "doc_id string, line_no bigint, ts_raw_ms bigint, text string").repartition(4)
    births = spark.createDataFrame([("a", i, i % 7 + 1) for i in range(0, 400, 2)], "doc_id string, line_no bigint, template_id int")
    done = completed(lines, births, start=-7)
    wide = [x for x in done._jdf.queryExecution().optimizedPlan().toString().split("\n") if "text" in x and "Repartition" in x]
    assert not wide
    got = {(r["doc_id"], r["line_no"]): (r["ts_ms"], r["template_id"], r["text"]) for r in store(done).lines.collect()}
    want, last = {}, -7
    for i, t in enumerate(raw):
        last = last if t is None else t
        want["a", i], want["b", i] = (last, 0 if i % 2 else i % 7 + 1, f"x{i}"), (last, 0, f"x{i}")
    assert got == want


def test_more_lines_come_beside(spark, small_chunks):
    first, more = stored(log_of(spark, range(100))), stored(log_of(spark, range(100, 230)).withColumn("line_no", F.col("line_no") + 100))
    both = first.with_more(more)
    assert both.count() == 230 and both.last_time() == 229 and first.count() == 100
    assert [r["line_no"] for r in both.range(90, 110).orderBy("line_no").collect()] == list(range(90, 110))
    assert both.first_at_or_after(99) == 99 and both.first_at_or_after(100) == 100


def hist(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(5))
def test_timelines_from_counts_equal_scans(spark, seed):
    rng = random.Random(seed)
    span = [1, 5, 40, 3_000, 10**9][seed]
    times = [None if rng.random() < 0.1 else 10**12 + rng.randrange(span) for _ in range(400)]
    lines = log_of(spark, times, seed)
    matched = search.matches(lines, ["error", "user=4", "nowhere"])
    counts = TimeCounts.of(lines, matched)
    for buckets in (16, 50, 2048):
        assert hist(counts.histogram(buckets)) == hist(analysis.histogram(lines, buckets=buckets))
        lanes = counts.histograms(buckets).where("lane >= 0 and cnt > 0").select("lane", F.col("bucket").cast("long"), "cnt")
        assert hist(lanes) == hist(analysis.lane_histogram(lines, matched, buckets))
    a, b = counts.lo + (counts.hi - counts.lo) // 4, counts.hi - (counts.hi - counts.lo) // 3
    known = [t if counts.by_time else i for i, t in enumerate(times) if t is not None or not counts.by_time]
    want = [0] * 30
    for t in known:
        if a <= t <= b:
            want[(t - a) * 30 // (b - a + 1)] += 1
    assert [r["cnt"] for r in counts.zoomed(a, b, 30).orderBy("col").collect()] == want


def test_counts_grow_with_the_log(spark):
    lines = log_of(spark, [10**6 + i * 977 % 5_000 for i in range(300)])
    cut = lambda lo, hi: lines.where(F.col("line_no").between(lo, hi - 1))
    of = lambda rows: search.matches(rows, ["error"])
    counts = TimeCounts.of(cut(0, 50), of(cut(0, 50)))
    for lo, hi in ((50, 60), (60, 60), (60, 300)):
        counts = counts.extended(cut(lo, hi), of(cut(lo, hi)))
    assert hist(counts.histograms(64).where("cnt > 0")) == hist(TimeCounts.of(lines, of(lines)).histograms(64).where("cnt > 0"))
    untimed = log_of(spark, [None] * 50)
    by_line = TimeCounts.of(untimed)
    assert not by_line.by_time and hist(by_line.histogram(16)) == hist(analysis.histogram(untimed, buckets=16))
    with pytest.raises(ValueError):
        by_line.extended(lines)
    with pytest.raises(ValueError):
        TimeCounts.of(lines.where("false"))


def test_few_edges_read_few_files(spark, uncoalesced):
    counts = TimeCounts.of(log_of(spark, range(N)))
    assert len(counts.files) > 1
    narrow = counts.details([counts.files[0][1]])
    assert len(narrow.inputFiles()) == 1 and len(counts.times.inputFiles()) > 1


@pytest.mark.parametrize("seed", range(3))
def test_bitmaps_equal_scans(spark, seed, monkeypatch):
    lines = log_of(spark, range(700), seed).withColumn("line_no", F.col("line_no") * 131)  # three buckets, with gaps
    filters = ["error", "user=4", "all", "nowhere"]
    maps = bitmaps.MatchBitmaps(lines)
    numbers = lambda df: sorted(r["line_no"] for r in df.select("line_no").collect())
    rng = random.Random(seed)
    for _ in range(4):
        active, others = [rng.random() < 0.5 for _ in filters], rng.random() < 0.5
        view = maps.lanes(filters, active, others)
        want = numbers(search.lanes(lines, filters, active, others))
        assert numbers(bitmaps.numbers(view)) == want and bitmaps.total(view) == len(want)
        for offset, limit in ((0, 7), (300, 50), (10_000, 5)):
            assert bitmaps.page_numbers(view, offset, limit) == want[offset : offset + limit]
    assert numbers(bitmaps.numbers(maps.all_of(["error", "user=4"]))) == numbers(lines.where(search.contains("error") & search.contains("user=4")))
    assert numbers(bitmaps.numbers(maps.all_of([]))) == numbers(lines)
    lo, hi = 20_001, 70_007
    inside = lines.where(F.col("line_no").between(lo, hi - 1))
    assert hist(maps.hits(filters, lo, hi)) == [(i, search.find(inside, f).count()) for i, f in enumerate(filters)]
    assert hist(maps.hits(filters)) == [(i, search.find(lines, f).count()) for i, f in enumerate(filters)]
    scans = []
    monkeypatch.setattr(bitmaps, "bitmaps_of", lambda *a, own=bitmaps.bitmaps_of: scans.append(a[1]) or own(*a))
    maps.lanes(["error", "new"], [True, True], False).count()
    maps.lanes(["error", "new"], [True, False], False).count()
    assert scans == [["new"]]  # one scan, for what wasn't there
    maps.release()
    assert not maps.known


def test_selections_like_lists(spark):
    from lumberline.operators.selection import Selection

    rng = random.Random(4)
    lanes = {0: sorted(rng.sample(range(50), 8)), 1: sorted(rng.sample(range(50), 5)), 2: []}
    hits = sorted(rng.sample(range(50), 6))
    matched = spark.createDataFrame([(f, n) for f, own in lanes.items() for n in own], "filter_id int, line_no bigint").cache()
    found = spark.createDataFrame([(n,) for n in hits], "line_no bigint").cache()
    own = Selection(matched, found, active=(True, False, True))
    near = lambda items, line: min(items, key=lambda n: (abs(n - line), n))
    for line in (0, 13, 27, 49, lanes[0][3], lanes[1][2]):
        for lane in (0, 1, 2):
            own.lane, own.mark = lane, None
            own.sync(line)
            assert own.mark == (near(lanes[lane], line) if lanes[lane] else None) and hits[own.place] == near(hits, line)
            own.follow(line)
            assert own.mark == (line if line in lanes[lane] and lane != 1 else None)
        own.lane = 0
        own.select(line)
        assert own.lane == 0 and own.line == line and own.mark == (line if line in lanes[0] else None)
        own.select(line, 1)
        assert own.lane == 1 and own.mark == (line if line in lanes[1] else None)
    nothing = Selection(matched)
    nothing.sync(3)
    nothing.select(3)
    assert (nothing.mark, nothing.place, nothing.line) == (None, None, 3)
