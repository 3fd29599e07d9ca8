"""Every query and every stage on odd tables: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import importlib.util
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumberline.llm import queries

#: Names that operators use for columns of their own.
CLASHES = ["id", "label", "score", "length", "piece", "offset", "sequence_id", "accepted", "unit", "component", "fingerprint", "h", "g", "r", "b", "hash", "row", "stretch", "n_words", "rank", "q", "size", "shard", "host", "line", "a.b"]
TOKENS = importlib.util.find_spec("public_tokenizers") is not None
NAMES = [n for n in queries.QUERIES if TOKENS or n not in ("op4_packing", "op13_bpe")]


def tables(spark, folder, clashing):
    rng = random.Random(9)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("ta", "ve", "xi", "zu", "po", "qua")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, prose(rng.randint(40, 120)) + (" you idiot" if i % 9 == 0 else "") + (" %%%" * 30 if i % 11 == 0 else ""), ("en", "fr", None)[i % 3], ("hot", "hot", "b", None)[i % 4]) for i in range(240)]
    docs += [(240 + i, docs[7][1], "en", "hot") for i in range(40)] + [docs[3]] * 3  # copies, and rows that occur again
    docs += [(None, prose(60), "en", "b"), (None, None, None, None), (400, None, "en", "b"), (401, "", "en", "hot"), (402, " \t\n", "fr", "c"), (403, prose(30_000), "en", "hot"), (404, "same line\n" * 500, "en", "hot"), (405, "日本語 ümläut \x00 a", "ja", "c"), (-1, "minus", "en", "c")]
    labels = [(i, int(i % 11 > 0), int(i % 9 == 0)) for i in range(240)] + [(None, 1, 1), (5, None, None), (7, 1, 0), (999, 0, 1)]
    vectors = [(i, [rng.choice((-0.5, 0.25, 0.5)) for _ in range(4)]) for i in range(150)] + [(200, None), (201, [0.5, None, 0.5, 0.5]), (202, [0.5, float("nan"), 0.5, 0.5]), (None, [0.5] * 4), (50, [0.25] * 4)]
    pages = [(i, f"http://{('hot', 'hot', 'b')[i % 3]}.example/{i}", f"<p>menu</p><p>{prose(8)}</p>") for i in range(90)] + [(90, None, "<p>x</p>"), (91, "http://b.example/", None), (92, "no url", ""), (None, "http://b.example/z", "<p>menu</p>"), (0, "http://hot.example/0", "<p>menu</p>")]
    frames = {
        "documents": spark.createDataFrame([(*d, None if d[1] is None else len(d[1])) for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "labels": spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        "embeddings": spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>"),
        "pages": spark.createDataFrame(pages, "page_id bigint, url string, html string"),
    }
    for name, df in frames.items():
        for c in clashing:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("clash"))
        df.write.parquet(f"{folder}/{name}.parquet")
        df.limit(0).write.parquet(f"{folder}/empty/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("plain"), [])


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("clashing"), CLASHES)


def rows(df):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_queries(spark, plain, clashing, name):
    query = queries.QUERIES[name]
    want = query(spark, plain)
    assert rows(query(spark, clashing)) == rows(want)
    n = {"op1_topk": None, "op5_mixing": None, "op4_packing": None, "op10_line_dedup": 95, "op11_whitening": 608, "op12_filter_audit": 2400}.get(name, 292)
    assert n is None or want.count() == n
    empty = query(spark, f"{plain}/empty")
    assert empty.count() == 0 and empty.columns == want.columns


@pytest.mark.parametrize("name,stage", [s for s in corpus_pipeline.STAGES if TOKENS or s[0] != "packing"])
def test_stages(spark, plain, clashing, name, stage):
    read = lambda folder: spark.read.parquet(f"{folder}/documents.parquet")
    bare, more = stage(spark, read(plain), plain), stage(spark, read(clashing), clashing)
    if name != "packing":
        assert more.columns == read(clashing).columns
        assert rows(more.select(*bare.columns)) == rows(bare)
    else:
        assert more.count() == bare.count()
    empty = stage(spark, read(f"{plain}/empty"), f"{plain}/empty")
    assert empty.count() == 0 and empty.columns == bare.columns


def test_stages_decide(spark, plain):
    docs = spark.read.parquet(f"{plain}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"] for r in stages["toxicity"](spark, docs, plain).collect()}
    assert not any(i in kept for i in range(0, 240, 9)) and all(i in kept for i in range(240) if i % 9)
    unlike = [r["doc_id"] for r in stages["near_dedup"](spark, docs, plain).collect()]
    assert {i for i in unlike if i is not None and 240 <= i < 280} == set() and unlike.count(3) == 1 and unlike.count(None) == 2
