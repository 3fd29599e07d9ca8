"""Sessions on stored logs: loads in the background, appends, saved filters, and tools that read what they need."""

import json
import os
import time

import pytest

from lumberline import loading
from lumberline.operators import bitmaps, ingest, timecounts
from lumberline.session import SavedFilter, Session, Store, ToolError
from lumberline.sources import spool


def line(i):
    return f"2026-07-19 {10 + i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d} {'ERROR boom' if i % 4 == 0 else 'INFO fine'} from user={i % 7}\n"


def written(path, n, start=0):
    with open(path, "a") as f:
        f.writelines(line(i) for i in range(start, start + n))
    os.utime(path, ns=(time.time_ns() + start, time.time_ns() + start))
    return str(path)


def tools(session):
    ranged = session.raw_log(start=11, end="2026-07-19 10:00:30")
    session.set_filters(["boom", "user=3"])
    return {
        "raw": ranged,
        "filtered": session.raw_log(start=5, end=40, max_lines=9, with_filtered_log=True),
        "hits": session.filter_hits(),
        "range hits": session.filter_hits(start=5, end=40),
        "timeline": session.get_timeline_histogram(buckets=20, with_filtered_log=False),
        "summary": {k: v for k, v in session.summarize_log().items() if k != "template_size_bytes"},
        "templates": session.get_template(),
        "view templates": session.get_template(with_filtered_log=True),
    }


def test_a_log_that_grows_is_like_one_load(spark, tmp_path):
    path = written(tmp_path / "x.log", 120)
    session = Session(spark)
    session.load_log(path)
    before = tools(session)
    assert before["hits"] == [{"keyword": "boom", "hits": 30}, {"keyword": "user=3", "hits": 17}] and session.poll() == {}
    assert [r["line"] for r in before["raw"]["lines"]] == list(range(11, 32))
    made = []
    own = bitmaps.bitmaps_of
    bitmaps.bitmaps_of = lambda lines, keywords: made.append(lines.count()) or own(lines, keywords)
    try:
        for start, n in ((120, 1), (121, 79)):
            written(path, n, start)
            assert list(session.poll()) == ["log_1"]
    finally:
        bitmaps.bitmaps_of = own
    assert made == [1, 79]  # only what came was scanned
    whole = Session(spark)
    whole.load_log(path)
    assert tools(session) == tools(whole)
    assert session.stats()["lines"] == 200


def test_appended_bytes_alone_are_read(spark, tmp_path, monkeypatch):
    path = written(tmp_path / "x.log", 50)
    log = ingest.open_log(spark, path)
    written(path, 30, 50)
    asked = []
    own = ingest.lines_from
    monkeypatch.setattr(ingest, "lines_from", lambda *a, **k: asked.append(a[2]) or own(*a, **k))
    monkeypatch.setattr(ingest, "read_lines", lambda *a: pytest.fail("the whole file was read"))
    grown = ingest.refreshed(spark, log)
    assert asked == [log.state.size] and grown.stored.count() == 80 and log.stored.count() == 50
    assert [r["line_no"] for r in grown.lines.orderBy("line_no").collect()] == list(range(80))
    monkeypatch.undo()
    whole = ingest.open_log(spark, path)
    same = lambda x: sorted(tuple(r) for r in x.lines.select("doc_id", "line_no", "text", "ts_ms", "content", "template_id").collect())
    assert same(grown) == same(whole)
    assert sorted(tuple(r) for r in grown.templates.collect()) == sorted(tuple(r) for r in whole.templates.collect())


def test_loads_in_the_background(spark, tmp_path):
    path = written(tmp_path / "x.log", 300)
    session = Session(spark)
    started = session.load_start(path)
    for _ in range(600):
        status = session.load_status(started["load_id"])
        if status["state"] != "running":
            break
        assert 0 <= status["done"] <= 1 and status["phase"] in ("", *ingest.PHASES, "done")
        time.sleep(0.1)
    assert status["state"] == "done" and status["lines"] == 300 and status["done"] == 1.0
    with pytest.raises(ToolError):
        session.load_status(started["load_id"])
    with pytest.raises(ToolError):
        session.load_start(str(tmp_path / "none"))


@pytest.mark.parametrize("phase", ["mining", "writing"])
def test_a_cancelled_load_leaves_nothing(spark, tmp_path, phase):
    path, folder = written(tmp_path / "x.log", 200), spool.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    reached = []

    def work(enter):
        def told(name):
            enter(name)
            if name == phase:
                reached.append(set(os.listdir(folder)) - before)
                load._cancelled.set()

        return ingest.open_log(spark, path, enter=told)

    load = loading.Load(spark, work)
    with pytest.raises(loading.Cancelled):
        load.result(120)
    assert load.cancel() and load.progress()["state"] == "cancelled"
    assert reached[0] and set(os.listdir(folder)) <= before
    failed = loading.Load(spark, lambda enter: ingest.open_log(spark, str(tmp_path / "none"), enter=enter))
    with pytest.raises(Exception, match="(?i)not.exist|not_found"):
        failed.result(60)
    assert failed.progress()["state"] == "failed"


def test_cancelling_stops_running_jobs(spark):
    def slow(enter):
        enter("parsing")
        spark.range(0, 8, 1, 8).mapInPandas(lambda it: [time.sleep(100) or x for x in it], "id bigint").count()

    load = loading.Load(spark, slow)
    while not load.progress()["tasks"]:
        time.sleep(0.1)
    start = time.time()
    assert load.cancel() and time.time() - start < 50
    with pytest.raises(loading.Cancelled):
        load.result()
    assert spark.range(5).count() == 5


def test_saved_filters_and_settings(spark, tmp_path):
    store = Store(str(tmp_path / "own"))
    store.save_filter(SavedFilter("errors", ("boom", "fatal")))
    store.set(default_filter="errors", depth=5, similarity=0.6, masks={"nums": False})
    assert store.parsing().depth == 5 and not store.parsing().masks.nums
    for bad in ({"depth": 2}, {"similarity": 3}, {"depth": "x"}):
        with pytest.raises(ValueError):
            store.set(**bad)
    session = Session(spark, store=store)
    session.load_log(written(tmp_path / "x.log", 30))
    assert session.get_filters() == ["boom", "fatal"] and session.config.depth == 5 and store.recent() == [str(tmp_path / "x.log")]
    session.set_filters(["fine"])
    assert session.save_filters("fine ones") == ["errors", "fine ones"] and session.saved_filters() == ["errors", "fine ones"]
    assert session.apply_filters("errors") == ["boom", "fatal"]
    with pytest.raises(ValueError):
        store.rename_filter("errors", "fine ones")
    for bad in ("none", "../x"):
        with pytest.raises(ToolError):
            session.apply_filters(bad)
    with pytest.raises(ToolError):
        Session(spark).saved_filters()
    (tmp_path / "own" / "settings.json").write_text(json.dumps({"depth": 1}))
    assert store.parsing() == ingest.ParsingConfig()
    (tmp_path / "own" / "settings.json").write_text("[]")
    assert store.settings() == {}


def test_watching(spark, tmp_path):
    path = written(tmp_path / "x.log", 20)
    session, told = Session(spark), []
    session.load_log(path)
    stop = session.watch(0.2, told.append)
    written(path, 5, 20)
    for _ in range(300):
        if told:
            break
        time.sleep(0.1)
    stop()
    assert told[0]["log_1"]["appended"] == 5


def test_closing_releases_all(spark, tmp_path):
    folder = spool.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    session = Session(spark)
    session.load_log(written(tmp_path / "x.log", 60))
    tools(session)
    assert set(os.listdir(folder)) - before
    session.close_log("log_1")
    assert set(os.listdir(folder)) <= before and timecounts.CELLS > 0
