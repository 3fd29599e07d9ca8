import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumberline.operators import mining
from lumberline.operators.mining import DrainConfig, mine, mine_in_order
from lumberline.plans import catalogue


def run(spark, contents, config):
    df = spark.createDataFrame([("d", i, c) for i, c in enumerate(contents)], "doc_id string, line_no bigint, content string")
    lines, templates = mine(df, config)
    ids = [r["template_id"] for r in lines.orderBy("line_no").collect()]
    return ids, [r["pattern"] for r in templates.orderBy("template_id").collect()], {r["template_id"]: r["count"] for r in templates.collect()}


@pytest.mark.parametrize("few", [0, 20_000])
@pytest.mark.parametrize("seed", range(6))
def test_parallel_mining_equals_the_tree(spark, seed, few, monkeypatch):
    monkeypatch.setattr(mining, "FEW_PATHS", few)
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "*", "<*>", "e1", "f2"]
    contents = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(300)]
    config = DrainConfig(rng.choice([3, 4, 5]), rng.choice([0.3, 0.5, 0.8, 1.0]), rng.choice([2, 3, 100]), rng.choice([4, 12, 20_000]))
    ids, patterns, counts = run(spark, contents, config)
    want_ids, want_patterns = mine_in_order(contents, config)
    assert ids == want_ids
    assert patterns == want_patterns
    assert all(counts[i] == want_ids.count(i) for i in counts)


def test_wildcards_and_blank(spark):
    ids, patterns, _ = run(spark, ["user bob in", "user eve in", "", "disk full now"], DrainConfig(depth=3))
    assert ids == [1, 1, 0, 2]
    assert patterns == ["<EMPTY>", "user <*> in", "disk full now"]
    with pytest.raises(ValueError):
        DrainConfig(depth=2)


def test_documents_are_mined_apart(spark):
    df = spark.createDataFrame([("x", 0, "a b"), ("y", 0, "c d"), ("y", 1, "a b")], "doc_id string, line_no bigint, content string")
    got = {(r["doc_id"], r["line_no"]): r["template_id"] for r in mine(df)[0].collect()}
    assert got == {("x", 0): 1, ("y", 0): 1, ("y", 1): 2}


@pytest.mark.parametrize("few", [0, 20_000])
def test_mining_on_equals_one_run(spark, few, monkeypatch):
    monkeypatch.setattr(mining, "FEW_PATHS", few)
    rng = random.Random(11)
    contents = [" ".join(rng.choice("abcdefgh*") for _ in range(rng.randint(0, 4))) for _ in range(240)]
    config = DrainConfig(max_children=3)
    want, patterns = mine_in_order(contents, config)
    rows = lambda lo, hi: spark.createDataFrame([("d", i, contents[i]) for i in range(lo, hi)], "doc_id string, line_no bigint, content string")
    before, births = None, {}
    for lo, hi in ((0, 50), (50, 51), (51, 240)):
        before = mining.mine_on(rows(lo, hi), config, before)
        births |= {r["line_no"]: r["template_id"] for r in before.births.collect()}
    assert [births.get(i, 0) for i in range(240)] == want
    got = {r["template_id"]: (r["pattern"], r["count"]) for r in before.templates.collect()}
    assert got == {i: (p, want.count(i)) for i, p in enumerate(patterns)}


def test_lines_are_read_twice_and_evaluated_once(spark):
    """The table of lines is scanned for the paths and for the replay; routing works on the table of paths alone."""
    contents = [f"job {i % 9} is {'done' if i % 2 else 'late'}" for i in range(100)]
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        calls.add(1)
        return x

    lines = spark.createDataFrame([("d", i, c) for i, c in enumerate(contents)], "doc_id string, line_no bigint, content string")
    mining.mine_on(lines.select("doc_id", "line_no", seen("content").alias("content")))
    assert calls.value == 100
    keyed = mining.spooled(mining.with_keys(lines, DrainConfig()))
    leaves, _ = mining.route(keyed, DrainConfig())
    scans = [x for x in leaves._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Relation" in x]
    assert len(scans) <= 1 and len(leaves.columns) == 6


def test_short_leaves_share_batches(spark):
    """Thousands of leaves of one line each come back in a few batches of Arrow, not in two each."""
    n = 3_000
    rows = pa.RecordBatch.from_pydict({
        "doc_id": pa.array([f"d{i:04}" for i in range(n)]), "leaf": pa.array(["1"] * n), "line_no": pa.array([0] * n, pa.int64()), "overflow": pa.array([False] * n),
        "content": pa.array([f"word{i}" for i in range(n)]), "birth": pa.nulls(n, pa.int64()), "size": pa.nulls(n, pa.int64()), "stop": pa.nulls(n, pa.int64()),
    })
    got = list(mining.replayed_batches(iter([rows.slice(0, 1_000), rows.slice(1_000)]), DrainConfig()))
    assert len(got) <= 5
    found = pa.Table.from_batches(got).to_pylist()
    assert sorted(r["doc_id"] for r in found if r["line_no"] == 0) == sorted(r["doc_id"] for r in found if r["template"]) == [f"d{i:04}" for i in range(n)]
    assert all(r["birth"] == 0 and (r["template"] is None or r["template"] == f"word{int(r['doc_id'][1:])}" and r["size"] == 1) for r in found)


def test_whole_lines_are_mined(spark):
    """Lines that differ after 4,096 bytes are of the same shape, and their templates have all tokens."""
    head = "start " + "x " * 3_000
    ids, patterns, _ = run(spark, [head + "é one", head + "é two", head + "é two three"], DrainConfig())
    assert ids == [1, 1, 2]
    assert patterns == ["<EMPTY>", head + "é <*>", head + "é two three"]
    assert (ids, patterns) == mine_in_order([head + "é one", head + "é two", head + "é two three"])


def test_all_clusters_of_a_leaf_are_compared(spark):
    contents = [f"a b {i}x {i}y {i}z" for i in range(300)]
    ids, patterns, counts = run(spark, [*contents, "a b 298x 298y new", "a b 3x new 3z"], DrainConfig())
    assert ids == [*range(1, 301), 299, 4]
    assert patterns[299] == "a b 298x 298y <*>" and patterns[4] == "a b 3x <*> 3z" and counts[299] == 2


@pytest.mark.parametrize("seed", range(8))
def test_clusters_compared_together_as_one_by_one(seed, monkeypatch):
    """Lengths are mixed in leaves of "*", where any similarity merges; literal wildcards occur."""
    rng = random.Random(seed)
    words = [*"abcdefgh", "<*>", "*"]
    contents = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(1_500)]
    config = DrainConfig(3, rng.choice([0.5, 0.7, 0.9]), rng.choice([2, 5, None]), rng.choice([40, 20_000, None]))
    found = []
    for few in (10**9, 0, 3):
        monkeypatch.setattr(mining, "FEW_CLUSTERS", few)
        found.append(mine_in_order(contents, config))
    assert found[0] == found[1] == found[2] and len(found[0][1]) > 10


def test_templates_of_documents_have_no_limits(spark, tmp_path):
    """130 lengths of lines, and 130 first words of one length: all are kept apart."""
    lines = [" ".join(f"{chr(97 + i % 26)}w" for _ in range(i)) for i in range(1, 131)] + [f"{chr(97 + i % 26)}{chr(97 + i // 26)}k q {'r' if i % 2 else 's'} {chr(97 + i % 26)}v" for i in range(130)]
    spark.createDataFrame([("d", "\n".join(lines))], "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.drain_documents(spark, str(tmp_path)).where("template_id > 0").orderBy("template_id").collect()
    assert [(r["pattern"], r["count"], r["example_line"]) for r in got] == [(line, 1, i) for i, line in enumerate(lines)]


def test_mining_without_limits_goes_on(spark):
    rng = random.Random(3)
    contents = [" ".join(rng.choice("abcdefgh*") for _ in range(rng.randint(0, 4))) for _ in range(240)]
    config = DrainConfig(max_children=None, max_clusters=None)
    want, patterns = mine_in_order(contents, config)
    rows = lambda lo, hi: spark.createDataFrame([("d", i, contents[i]) for i in range(lo, hi)], "doc_id string, line_no bigint, content string")
    before = mining.mine_on(rows(0, 100), config)
    after = mining.mine_on(rows(100, 240), config, before)
    births = {r["line_no"]: r["template_id"] for r in [*before.births.collect(), *after.births.collect()]}
    assert [births.get(i, 0) for i in range(240)] == want
    got = {r["template_id"]: (r["pattern"], r["count"]) for r in after.templates.collect()}
    assert got == {i: (p, want.count(i)) for i, p in enumerate(patterns)}


def test_templates_alone_equal_those_of_mining(spark):
    """Documents without blank lines, of blank lines alone and without an id are among them."""
    rng = random.Random(5)
    rows = [(d, i, " ".join(rng.choice("abcd*") for _ in range(rng.randint(0 if d != "full" else 1, 4)))) for d in ("x", "full", None) for i in range(80)] + [("blank", i, " ") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id string, line_no bigint, content string")
    found = mining.templates_of(df)
    want = mine(df, DrainConfig(max_children=None, max_clusters=None))[1]
    assert found.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    with pytest.raises(ValueError):
        mining.templates_of(df, DrainConfig())
