"""Whitening, the audit of filters and byte-pair encoding against brute force."""

import hashlib
import itertools
import math
import os
import random

import duckdb
import numpy as np
import pytest

from lumberline.llm import bpe, filter_audit, whitening

SF = "/root/testdata/sf0.001"


# ---- whitening ----


def brute_whitening(vectors, k=16):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    centred = (fit * n - total).astype(float) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1][:k], columns[:, ::-1][:, :k]
    white = ((x * n - total).astype(float) / n) @ columns / np.sqrt(values)
    return n, [int(v) for v in ((x * n - total) ** 2).sum(axis=1)], white, values / np.trace(centred.T @ centred / n)


def test_whitening_like_brute_force(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(20, 20))
    vectors = (rng.normal(size=(300, 20)) @ mix * 0.3 + 2).astype(np.float32).tolist()
    vectors += [vectors[0]] * 200  # a third of all rows
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<float>").repartition(7)
    model = whitening.fit_whitening(df)
    n, deviations, white, explained = brute_whitening(vectors)
    rows = sorted(whitening.whitened(df, model, "vec_id").collect(), key=lambda r: r["vec_id"])
    assert model.n == n and [r["deviation"] for r in rows] == deviations
    assert np.allclose(model.explained, explained, rtol=1e-9) and model.identity_error < 1e-9
    got = np.array([r["whitened"] for r in rows])
    assert got.shape == (500, 16)
    assert np.allclose(got * np.sign((got * white).sum(axis=0)), white, atol=1e-7)


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)) + 1e6
    whole = whitening.Moments.of(x)
    for cuts in ([10], [1, 49], [0, 20, 20, 50]):
        parts = [whitening.Moments.of(p) if len(p) else whitening.Moments.none(4) for p in np.split(x, cuts)]
        random.Random(len(cuts)).shuffle(parts)
        merged = whitening.Moments.none(4)
        for p in parts:
            merged = merged.merged(p)
        assert merged.n == 50 and np.allclose(merged.mean, whole.mean) and np.allclose(merged.scatter, whole.scatter, atol=1e-6)


def test_whitening_of_odd_tables(spark):
    kind = "vec_id bigint, embedding array<double>, x int, deviation string"
    odd = [(None, [1.0, 2.0]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [None, 1.0]), (6, [3.0, -1.0]), (6, [3.0, -1.0]), (7, [0.5, 0.25]), (8, [1.0, 2.0, 3.0]), (9, [1e300, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in odd], kind)
    model = whitening.fit_whitening(df)
    rows = whitening.whitened(df, model, "vec_id").collect()
    assert model.n == 3 and sorted(str(r["vec_id"]) for r in rows) == ["6", "6", "7", "None"]
    assert all(len(r["whitened"]) == 2 for r in rows) and model.identity_error < 1e-9
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")], kind)
    flat = whitening.fit_whitening(one)
    assert flat.n == 1 and flat.identity_error == 0.0
    assert [tuple(r) for r in whitening.whitened(one, flat, "vec_id").orderBy("vec_id").collect()] == [(1, 0, [None, None]), (2, 0, [None, None])]
    none = df.where("false")
    empty = whitening.fit_whitening(none)
    assert empty.n == 0 and whitening.whitened(none, empty, "vec_id").count() == 0
    wide = spark.createDataFrame([(1, [1e9, 0.0], 0, ""), (2, [-1e9, 1.0], 0, "")], kind)
    fitted = whitening.fit_whitening(wide)
    assert [r["deviation"] for r in whitening.whitened(wide, fitted, "vec_id").collect()] == [None, None]  # beyond a long


def test_op11_like_brute_force(spark):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    source = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviations, white, explained = brute_whitening([r["embedding"] for r in source])
    rows = whitening.op11_whitening(spark, SF).orderBy("vec_id", "component").collect()
    assert [(r["vec_id"], r["component"]) for r in rows] == [(r["vec_id"], c) for r in source for c in range(1, 17)]
    assert {r["n"] for r in rows} == {n} and [r["deviation"] for r in rows[::16]] == deviations
    assert np.allclose([r["explained"] for r in rows[:16]], explained, rtol=1e-6)
    got = np.array([r["whitened"] for r in rows]).reshape(-1, 16)
    assert np.allclose(got * np.sign((got * white).sum(axis=0)), white, atol=1e-6)
    assert {r["identity_error"] for r in rows}.pop() < 1e-4


# ---- filters ----


def brute_audit(docs, labels):
    fails = {}
    for i, (doc, text, part) in enumerate(docs):
        text = text or ""
        words = text.encode().split()
        mask = set()
        if len(words) < 200:
            mask.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            mask.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            mask.add("C")
        if any(c in "#$%&*|" for c in text):
            mask.add("D")
        if doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs):
            mask.add("E")
        fails[i] = mask
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = {}
    for part in {p or "" for _, _, p in docs}:
        here = [i for i, (_, _, p) in enumerate(docs) if (p or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = set(here)
            for step, f in enumerate(order, 1):
                gone = {i for i in alive if f in fails[i]}
                redundant = sum(f in fails[i] for i in set(here) - alive)
                alive -= gone
                out[part, order, step] = (len(alive), len(gone), redundant, sum(fails[i] == {f} for i in here), sum(docs[i][0] in good for i in gone), sum(docs[i][0] in toxic for i in gone))
    return {k: (*v, sum(w[1] for (p, o, s), w in out.items() if p == k[0] and o[s - 1] == k[1][k[2] - 1])) for k, v in out.items()}


def report(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_audit_like_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "bee", "Sea", "D#", "eff"]
    texts = [" ".join(rng.choice(words[: rng.randrange(1, 6)]) if rng.random() < 0.6 else f"w{rng.randrange(999)}" for _ in range(rng.choice([0, 5, 199, 200, 300]))) for _ in range(40)]
    texts += [None, "", "", "ÀB" * 300, " ", "A B " * 250]
    docs = [(rng.choice([i, i, i, 7, None]), rng.choice(texts), rng.choice(["x", "y", None, ""])) for i in range(150)]
    docs += [(1000 + i, "the same text", "x") for i in range(75)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1060, 2)] + [(4, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, source string, mask int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert report(filter_audit.audit_filters(table, marks)) == brute_audit(docs, labels)
    assert filter_audit.audit_filters(table.where("false"), marks).count() == 0
    assert {v[4:6] for v in report(filter_audit.audit_filters(table, marks.where("false"))).values()} == {(0, 0)}


def test_op12_equals_sql(spark):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = con.execute(filter_audit.OP12_SQL)
    columns = [c[0] for c in result.description]
    want = sorted(repr(sorted(zip(columns, row))) for row in result.fetchall())
    got = sorted(repr(sorted(r.asDict().items())) for r in filter_audit.op12_filter_audit(spark, SF).collect())
    assert got == want and len(got) % 600 == 0


# ---- byte pairs ----


@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path(bpe.TOKENIZER))


def odd_texts():
    rng = random.Random(5)
    texts = ["", " \t\n", "it's 'S 's've", "<|endoftext|>a<|startoftext|> <|END|>", "x" * 5000, "\x1c\x1dAb\x85c ", "İI ΑΣ Σ é ́", "你好 ½ ² ٣ 😀👍🏽", "aaaa" * 99]
    letters = "abcdeilnorstAS'<|>é́İßΣ½1 \t\n\x0b\x1c\x85​😀9-_ȀȺ"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x3000), rng.randrange(0xE000, 0x20000)])) for _ in range(15)) for _ in range(500)]
    return texts + ["".join(rng.choice("aetosinrh") for _ in range(60)) for _ in range(500)]


def test_prefixes_give_the_ids_of_merging(library):
    own, back = bpe.loaded(bpe.TextEncoder, bpe.TOKENIZER), bpe.loaded(bpe.IdDecoder, bpe.TOKENIZER)
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert memoryview(ids).cast("I").tolist() == want, text
        assert back.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_unsound_tokens_are_never_used():
    """A vocabulary whose last merge never happens in its own text: c joins b before a does."""
    merges = [["b", "c"], ["a", "b"], ["ab", "c"]]
    names = [*"abc", *(x + "/" for x in "abc"), "bc", "ab", "abc"]
    pairs = bpe.PairMerges({n: i for i, n in enumerate(names)}, merges, "/")
    abc = names.index("abc")
    assert not pairs.sound(abc)
    assert [names[i] for i in pairs.encode("abca")] == ["a", "bc", "a/"]


def test_tables_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "STRETCHES", 20)
    own = bpe.TextEncoder(__import__("public_tokenizers").path(bpe.TOKENIZER))
    for text in odd_texts()[:300]:
        assert memoryview(own.encode(text)).cast("I").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.known) <= 20 and len(own.merged) <= 50 and len(own.merges._pairs) <= 50


def test_op13_like_the_library(spark, library, tmp_path):
    texts = [*odd_texts()[:200], None, "the same", "the same"]
    spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i or None, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.op13_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_encode_keeps_columns(spark):
    df = spark.createDataFrame([("a b", 1, "z"), (None, None, None)], "text string, `odd.na me` int, ids string")
    with pytest.raises(ValueError):
        bpe.encode_texts(df, ["ids"])
    rows = bpe.encode_texts(df, ["odd.na me", "text"], out="coded")
    assert rows.columns == ["odd.na me", "text", "coded"]
    assert sorted((r["text"] or "", len(r["coded"])) for r in rows.collect()) == [("", 0), ("a b", 8)]
    assert bpe.encode_texts(df.where("false"), ["text"]).count() == 0
    assert [r["decoded"] for r in bpe.decode_ids(spark.createDataFrame([(None,)], "ids binary"), []).collect()] == [""]


def test_texts_are_encoded_and_decoded_by_one_worker(spark, library, tmp_path):
    """A second pass over the ids has a second worker beside each, with tables of its own."""
    df = spark.createDataFrame([(1, "Plain words, 1.5 ümläut 日本"), (2, None), (3, "")], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert bpe.op13_bpe(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    both = bpe.encode_texts(df, ["doc_id"], decoded="back")
    again = bpe.decode_ids(bpe.encode_texts(df, ["doc_id"]), ["doc_id", "ids"], out="back")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(ValueError):
        bpe.encode_texts(df, ["doc_id"], decoded="ids")
