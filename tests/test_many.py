"""Many logs opened together, and a stored log as a data source."""

import json
import random

import pytest

from lumberline.functions.timefmt import CustomFormat
from lumberline.operators import ingest, many
from lumberline.session import Session, ToolError
from lumberline.sources import logsource
from lumberline.sources import stored as stored_module
from lumberline.sources.versions import LogFolder

CUSTOM = (CustomFormat("dashes", r"<(?P<day>\d+)-(?P<month>\d+)-(?P<year>\d+) (?P<hour>\d+):(?P<min>\d+):(?P<sec>\d+)>"),)


def files(folder):
    rng = random.Random(2)
    clock = lambda i: f"{10 + i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}"
    kinds = {
        "plain": lambda i: f"2026-03-04T{clock(i)}.250Z INFO job {i} {rng.choice(['done', 'late'])}",
        "header": lambda i: f"2026-03-04 {clock(i)} Shop[{4000 + i}:{i}] Cart.swift:{i} item {i} sold",
        "json": lambda i: json.dumps({"time": f"2026-03-04T{clock(i)}Z", "msg": f"user {i} in", "n": i}),
        "cef": lambda i: f"CEF:0|Acme|Gate|2.4|{i}|seen|3|who={i}",
        "rfc": lambda i: f"<134>1 2026-03-04T{clock(i)}Z edge app {i} id_31 - disk {i} full",
        "logcat": lambda i: f"D/Radio: cell {i} lost",
        "console": lambda i: f"[Disk:main] WARNING: sector {i} slow",
        "custom": lambda i: f"<04-03-2026 {clock(i)}> valve {i} open",
        "traced": lambda i: f"2026-03-04 {clock(i)} call {i}" if i % 3 else f"    at frame {i}",
        "untimed": lambda i: rng.choice(["red", "green", ""]) + f" light {i}",
        "blanks": lambda i: "" if i < 90 else f"2026-03-04 {clock(i)} after blanks",
    }
    out = []
    for name, line in kinds.items():
        for n in (120, 5):
            path = folder / f"{name} {n}.log"
            path.write_text("".join(line(i) + "\n" for i in range(n)))
            out.append(str(path))
    return out


def same(log):
    lines = [tuple(r) for r in log.lines.select("line_no", "text", "n_bytes", "ts_raw_ms", "ts_ms", "content", "template_id").orderBy("line_no").collect()]
    return log.fmt.name, log.family and log.family.name, log.header, lines, sorted(tuple(r)[1:] for r in log.templates.collect())


def test_each_log_is_as_if_opened_alone(spark, tmp_path):
    paths = files(tmp_path)
    found = many.open_logs(spark, paths, custom=CUSTOM)
    names = [r["doc_id"] for r in found.formats.collect()]
    assert len(names) == len(paths)
    for path in paths[:: 1]:
        name = next(n for n in names if n.endswith(path.rsplit("/", 1)[-1].replace(" ", "%20")))
        alone = ingest.open_log(spark, path, custom=CUSTOM)
        together = found.log(name, path)
        assert same(together) == same(alone), path
        assert together.stored.count() == alone.stored.count() and together.stored.last_time() == alone.stored.last_time()
        alone.release()
    with pytest.raises(KeyError):
        found.log("none")
    found.release()


def test_a_session_of_many_logs(spark, tmp_path):
    paths = files(tmp_path)[:4] + [str(tmp_path / "empty.log")]
    (tmp_path / "empty.log").write_text("")
    session = Session(spark)
    found = session.load_logs(paths)
    assert [f["lines"] for f in found] == [120, 5, 120, 5, 0] and session.load_logs([]) == []
    with open(paths[0], "a") as f:
        f.write("2026-03-04T11:00:00.000Z INFO job 7 done\n")
    assert list(session.poll()) == ["log_1"] and session.stats("log_1")["lines"] == 121 and session.stats("log_2")["lines"] == 5
    session.close_log("log_2")
    assert session.raw_log(start=120, end=121, log_id="log_1")["lines"][-1]["text"].endswith("job 7 done")
    assert session.raw_log(start=1, end=2, log_id="log_3")["returned"] == 2
    for i in ("log_1", "log_3", "log_4"):
        session.close_log(i)
    with pytest.raises(ToolError):
        session.load_logs([str(tmp_path / "none")])


def test_filters_reach_the_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_module, "CHUNK", 50)
    monkeypatch.setattr(ingest, "HEAD_LINES", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    path = tmp_path / "x.log"
    path.write_text("".join(f"2026-03-04T10:{i // 60:02d}:{i % 60:02d}.000Z job {i} done\n" for i in range(1000)))
    folder = LogFolder(spark, str(tmp_path / "versions"))
    try:
        with folder.writing():
            log = ingest.open_log(spark, str(path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folder.commit(log)
    logsource.register(spark)
    source = spark.read.format("lumberline-log").option("folder", str(tmp_path / "versions")).load()
    source.createOrReplaceTempView("own_log")
    whole = sorted(tuple(r) for r in log.lines.collect())
    assert source.schema == log.lines.schema and sorted(tuple(r) for r in source.collect()) == whole
    got = spark.sql("select line_no from own_log where line_no >= 120 and line_no < 130")
    assert sorted(r[0] for r in got.collect()) == list(range(120, 130))
    t = log.stored.last_time() - 5000
    assert spark.sql(f"select count(*) from own_log where ts_ms > {t}").first()[0] == 5
    assert spark.sql("select count(*) from own_log where line_no = 5000").first()[0] == 0
    # the partitions that are planned: all files, one file, none
    count = lambda tests: len([p for p in made(tests).partitions() if p.file])

    def made(tests):
        reader = logsource.LogReader(log.lines.schema, logsource._manifest(str(tmp_path / "versions"), "1"))
        assert list(reader.pushFilters(tests)) == tests
        return reader

    every = count([])
    assert every > 1 and count([logsource.EqualTo(("line_no",), 7)]) == 1 and count([logsource.GreaterThan(("ts_ms",), t)]) == 1
    assert count([logsource.LessThan(("line_no",), 0)]) == 0 and count([logsource.EqualTo(("text",), "x")]) == every
    with pytest.raises(FileNotFoundError):
        logsource._manifest(str(tmp_path), None)
