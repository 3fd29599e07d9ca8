import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lumberline.llm import common, line_dedup, mixing, packing, sharding, simhash, substring, topk
from lumberline.llm.components import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


ODD = [(1, "a b c", "x"), (None, "no id", "x"), (2, None, None), (3, "", "y"), (3, "", "y"), (4, "long " * 5000, "x"), (5, " \t\n", "y")]


def test_shuffle_is_a_permutation(spark):
    rows = ODD + [(i, f"text {i % 7}", "z") for i in range(10, 400)]
    df = docs(spark, rows)
    got = sharding.external_shuffle(df, shards=24, bucket_bytes=4000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, _ in rows)
    assert sorted(r["shuffle_position"] for r in got) == list(range(len(rows)))
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    again = sharding.external_shuffle(df.repartition(3), shards=24, bucket_bytes=4000).collect()
    assert {(r["doc_id"], r["text"], r["shuffle_position"]) for r in got if r["doc_id"] != 3} == {(r["doc_id"], r["text"], r["shuffle_position"]) for r in again if r["doc_id"] != 3}
    assert sharding.external_shuffle(df.limit(0)).count() == 0
    assert sorted(sharding.fisher_yates(50, 1, 2)) == list(range(50))


def test_shuffle_like_one_list(spark):
    """The whole shuffle again on one list: buckets by hash, each sorted and swapped, laid end to end and cut."""
    rows = ODD + [(i, f"text {i % 7}", "z") for i in range(10, 300)]
    df = docs(spark, rows)
    seed, shards, bucket_bytes = 20_240_501, 7, 700
    hashed = df.select("doc_id", "text", common.seeded_hash(seed, F.col("doc_id"), F.col("text")).alias("h")).collect()
    size = sum(len((r["text"] or "").encode()) + 8 for r in hashed)
    buckets = max(1, -(-size // bucket_bytes), common.n_partitions(spark))
    laid = []
    for bucket in range(buckets):
        own = sorted((r for r in hashed if r["h"] % buckets == bucket), key=lambda r: (r["h"], r["doc_id"] is None, r["doc_id"] or 0))
        draws = np.random.Generator(np.random.PCG64([seed, bucket])).random(len(own))
        for i in range(len(own) - 1, 0, -1):
            j = int(draws[i] * (i + 1))
            own[i], own[j] = own[j], own[i]
        laid += own
    want = []
    for shard in range(shards):
        first, last = len(laid) * shard // shards, len(laid) * (shard + 1) // shards
        want += [(r["doc_id"], r["text"], shard, slot) for slot, r in enumerate(laid[first:last])]
    got = sharding.external_shuffle(df, shards=shards, seed=seed, bucket_bytes=bucket_bytes).orderBy("shuffle_position").collect()
    assert [(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in got] == want


def test_shuffle_moves_texts_once(spark):
    """Neither side of a join is broadcast here, as on large tables or when sizes come late."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {name: spark.conf.get(name) for name in settings}

    def widths(plan):
        nodes = plan.children()
        found = [plan.output().size()] if plan.nodeName() == "Exchange" else []
        return found + [w for i in range(nodes.size()) for w in widths(nodes.apply(i))]

    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        df = docs(spark, ODD + [(i, f"text {i % 7}", "z") for i in range(10, 100)])
        got = sharding.external_shuffle(df, shards=7, bucket_bytes=400)
        exchanges = widths(got._jdf.queryExecution().executedPlan())
        assert len([w for w in exchanges if w >= len(df.columns)]) == 1, exchanges
        assert sorted(r["shuffle_position"] for r in got.collect()) == list(range(df.count()))
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_shards_are_written(spark, tmp_path):
    df = docs(spark, [(i, str(i), "z") for i in range(50)])
    sharding.write_shards(sharding.external_shuffle(df, shards=4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


def test_line_dedup(spark):
    rows = [(i, f"Menu \nbody {i}\n\nfooter" + ("\nrare" if i < 4 else ""), "h1") for i in range(20)]
    rows += [(50, "Menu\nother", "h2"), (51, None, "h1"), (52, "Menu", None), (53, "", "h1")]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs(spark, rows), "doc_id", "source", "text", max_ratio=0.5).collect()}
    assert got[7]["text"] == "body 7\n" and (got[7]["n_lines"], got[7]["n_dropped"]) == (4, 2)
    assert got[0]["text"] == "body 0\n\nrare"
    assert got[50]["text"] == "Menu\nother" and got[51]["text"] is None and got[52]["text"] == "Menu" and got[53]["text"] == ""
    shuffled = line_dedup.line_dedup(docs(spark, rows), "doc_id", "source", "text", max_ratio=0.5, broadcast_lines=0)
    assert {r["doc_id"]: r["text"] for r in shuffled.collect()} == {i: r["text"] for i, r in got.items()}
    copies = docs(spark, [(i, "one page\ncopied", "h") for i in range(30)] + [(100 + i, f"own {i}\nshared", "h") for i in range(10)])
    kept = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(copies, "doc_id", "source", "text", 0.4, distinct_pages=True).collect()}
    assert kept[3] == "one page\ncopied" and kept[104] == "own 4"
    assert line_dedup.line_dedup(copies.limit(0), "doc_id", "source", "text").count() == 0


def test_boilerplate_of_small_sources(spark):
    import corpus_pipeline

    rows = [(i, f"own {i}" + ("\nshared" + "\t\u00a0" * (i % 2) if i < 4 else ""), "small") for i in range(15)]
    rows += [(20 + i, f"menu\ntext {i}", "tiny") for i in range(2)] + [(30, "menu\nalone", "single")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.boilerplate_lines(spark, docs(spark, rows), "").collect()}
    assert [got[i] for i in range(15)] == [f"own {i}" for i in range(15)]
    assert (got[20], got[21], got[30]) == ("text 0", "text 1", "menu\nalone")


def edf(units, period):
    """Earliest deadline first by hand."""
    done, out = dict.fromkeys(units, 0), []
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // q), s) for s, q in sorted(units.items()) if done[s] < q and done[s] * period // q <= t]
        out.append(min(ready)[1])
        done[out[-1]] += 1
    return out


def test_mixing_follows_the_weights(spark):
    weights = {"a": 5, "b": 3, "c": 2}
    rows = [(i, f"t{i}", s) for i, s in enumerate("a" * 300 + "b" * 400 + "c" * 90)]
    got = mixing.mix_sources(docs(spark, rows), weights=weights, period=50, block_rows=4).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(len(rows)))
    slots = {r["mix_slot"]: r["source"] for r in got}
    assert len(slots) == len({(r["source"], r["mix_block"]) for r in got})
    units = {r["source"]: r["units"] for r in mixing.target_units(spark.createDataFrame([(s, n) for s, n in (("a", 300), ("b", 400), ("c", 90))], "source string, rows bigint"), weights, 0.5, 50).collect()}
    assert sum(units.values()) == 50
    want = edf(units, 50)
    for t in range(100):
        assert slots[t] == want[t % 50]
    count = Counter()
    for t in range(100):  # no source has run out yet
        count[slots[t]] += 1
        assert all(abs(count[s] - units[s] * (t + 1) / 50) < 1 for s in units)
    order = sorted(got, key=lambda r: r["mix_position"])
    assert [r["mix_slot"] for r in order] == sorted(r["mix_slot"] for r in got)


def test_mixing_odd_rows(spark):
    got = mixing.mix_sources(docs(spark, ODD), period=20, block_rows=2)
    assert sorted(r["mix_position"] for r in got.collect()) == list(range(len(ODD)))
    assert mixing.mix_sources(docs(spark, ODD).limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs(spark, [(i, "t", f"s{i}") for i in range(30)]), period=40)


def test_mixing_of_many_sources(spark):
    assert mixing.pfair_slots([5, 3, 2], 10) == ["abc".index(s) for s in edf({"a": 5, "b": 3, "c": 2}, 10)]
    counts = spark.createDataFrame([(f"s{i:03}", 1) for i in range(300)], "source string, rows bigint")
    weights = {f"s{i:03}": 150.0 if i == 0 else 1.0 for i in range(300)}
    period = mixing.chosen_period(counts, weights, 0.5)
    for found in (mixing.target_units(counts, weights, 0.5, period), mixing.scheduled_by_driver(counts, weights, 0.5, period)):
        units = {r["source"]: r["units"] for r in found.select("source", "units").distinct().collect()}
        assert len(units) == 300 and sum(units.values()) == period
        assert all(abs(units[s] - w / 449 * period) < 1 for s, w in weights.items())
    rows = [(i, f"t{i}", f"s{i % 600}") for i in range(1800)]
    got = mixing.mix_sources(docs(spark, rows), block_rows=1).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(1800))
    for n in (600, 1200):  # the same weight for all: one block of each source in each 600 slots, give or take one
        seen = Counter(r["source"] for r in got if r["mix_slot"] < n)
        assert all(abs(seen[f"s{i}"] - n / 600) < 1 for i in range(600))


def test_ordinals_without_hot_tasks(spark):
    df = spark.createDataFrame([(k, h * 10**15 - 9 * 10**18) for k, n in (("a", 500), (None, 300), ("b", 1)) for h in range(n)], "k string, h bigint")
    got = common.ordinal_within(df, "k", "h", "o", rows_per_task=50).collect()
    for k in ("a", None, "b"):
        mine = sorted((r["h"], r["o"]) for r in got if r["k"] == k)
        assert [o for _, o in mine] == list(range(len(mine)))


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(300)] + [(1000 + i, [0.25] * 6) for i in range(40)]
    odd = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [1.0] * 6), (2004, [1.0, 2.0]), (2004, [1.0, 3.0])]
    df = spark.createDataFrame(vectors + odd, "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df.where("vec_id % 50 = 0"), df, bins=64).collect()}
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors}
    for q in [i for i in whole if i % 50 == 0]:
        best = sorted(((int(whole[q] @ v), i) for i, v in whole.items() if i != q), key=lambda x: (-x[0], x[1]))[:5]
        assert [got[(q, k + 1)] for k in range(5)] == [(i, s) for s, i in best]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(common.WORD, text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice("abC \n\x0bÄ") for _ in range(rng.randint(0, 60)))
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("large", [2, 16_384])
def test_links_lose_nothing(spark, large):
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 2**63, 12).astype(np.uint64)
    prints = set(rng.integers(0, 2**63, 100).astype(np.uint64).tolist())
    for c in centres:
        for _ in range(15):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            prints.add(int(c) ^ sum(1 << int(b) for b in flips))
    f = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(x,) for x in f.view(np.int64).tolist()], "f bigint")
    links = [(r["a"], r["b"]) for r in simhash.near_links(df, 4, large).collect()]
    root = {x: x for x in f.view(np.int64).tolist()}

    def find(r, x):
        while r[x] != x:
            x = r[x]
        return x

    want = dict(root)
    for i in range(len(f)):
        for j in range(i):
            if int(f[i] ^ f[j]).bit_count() <= 4:
                a, b = find(want, int(f[i].view(np.int64))), find(want, int(f[j].view(np.int64)))
                want[max(a, b)] = min(a, b)
    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 4
        x, y = find(root, a), find(root, b)
        root[max(x, y)] = min(x, y)
    assert {x: find(root, x) for x in root} == {x: find(want, x) for x in want}


def test_near_duplicates_odd_rows(spark):
    rows = ODD + [(20, "one two three four five", "z"), (21, "One two three four five", "z"), (22, "something quite different here", "z")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["id"]: r["component"] for r in got}
    assert (by_id[20], by_id[21], by_id[22], by_id[None]) == (20, 20, 22, None)
    assert by_id[2] == by_id[3] == by_id[5] == 2
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_similar_texts_are_linked_whole(spark):
    rng = random.Random(8)
    rows = []
    for k in range(25):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(rng.randint(3, 120))]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = "changed" + str(rng.randint(0, 9))
            rows.append((len(rows), " ".join(words), "z"))
    rows += [(900, None, "z"), (901, " ", "z"), (None, rows[0][1], "z")]
    got = {r["id"]: r["component"] for r in simhash.near_duplicates(docs(spark, rows), width=5, similarity=0.8).collect()}
    sets = {}
    for i, t, _ in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets if i is not None}
    for i in root:
        for j in root:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = root[i], root[j]
                root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    assert {i: c for i, c in got.items() if i is not None} == root and got[None] is None
    assert len(set(root.values())) < len(root) - 20
    assert simhash.near_duplicates(docs(spark, rows).limit(0), width=5, similarity=0.8).count() == 0


def test_near_dedup_stage_goes_by_similarity(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    copy = [*words[:50], "other", *words[51:]]  # 91 of 101 shingles in common
    rows = [(1, " ".join(words), "x"), (2, " ".join(copy), "x"), (3, " ".join(words[:70]), "x")]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()) == [1, 3]


def test_thresholds_are_the_cheapest():
    cost, chosen = simhash.allocate([[5.0, 50.0], [1.0, 2.0], [9.0, 90.0], [4.0, 40.0]], 4)
    assert (cost, chosen) == (20.0, [0, 1, 0, 0])
    assert simhash.allocate([[5.0, 50.0, 60.0], [1.0, 2.0, 3.0], [9.0, 90.0, 99.0]], 4) == (17.0, [0, 2, 0])


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(200)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(500, 500), (None, 3)]
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(links, "a bigint, b bigint"), rounds=1)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(201))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links[200:260]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert all(got[x] == find(x) for x in root if x in got)


def brute_repeats(rows, width):
    least = {}
    words = [re.findall(common.WORD, t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - width + 1):
            if i is not None:
                k = tuple(w[p : p + width])
                least[k] = min(least.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = {p + k for p in range(len(w) - width + 1) if i is not None and least[tuple(w[p : p + width])] < i for k in range(width)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def test_repeats_against_brute_force(spark):
    rng = random.Random(9)
    passage = [rng.choice("abc") for _ in range(12)]
    rows = [(i, " ".join([rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))] + (passage if i % 3 == 0 else []))) for i in range(60)]
    rows += [(7, rows[3][1]), (None, rows[3][1]), (80, None), (81, ""), (2, rows[30][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring.remove_repeats(df, width=5, group_bytes=300).collect()
    assert sorted(((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=repr) == brute_repeats(rows, 5)
    for r in got:
        assert sum(x["end"] - x["start"] for x in r["intervals"]) == r["n_removed"]
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_sorted_hashes_round_trip():
    x = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (substring.unpack_sorted(substring.pack_sorted(x)) == x).all()


def test_words_encode_like_whole_texts():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    encoder, plain = packing.WordEncoder(path), Tokenizer.from_file(path)
    texts = ["", " ", "a  b", "a   b ", " \n x", "x \n", "it's 's 12 a1,b  c \t d", "<|endoftext|> x", "é  ü", "a\n\nb  \n c", "words and words"]
    rng = random.Random(2)
    texts += ["".join(rng.choice(" \n\tab'1,é") for _ in range(30)) for _ in range(300)]
    ids, ends = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*plain.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]


def check_packing(placed, capacity):
    used = {}
    for length, sequence, offset in placed:
        assert offset >= 0 and offset + length <= capacity
        used.setdefault(sequence, []).append((offset, length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    return len(used)


@pytest.mark.parametrize("seed", range(5))
def test_packing_places_every_piece(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 64), rng.randint(20, 40), 64, 3]) for _ in range(3000))
    placed = []
    for size, lo, hi, first, each, at in packing.pack_counts(counts, 64):
        placed += [(size, first + i // each, at + i % each * size) for i in range(hi - lo)]
    assert Counter(p[0] for p in placed) == counts
    n = check_packing(placed, 64)
    large = sum(c for s, c in counts.items() if 2 * s > 64)
    assert n <= max(-(-sum(s * c for s, c in counts.items()) // 64), large) * 1.05 + 1


def packed_one_by_one(lengths, capacity):
    """The number of sequences when pieces are placed one at a time: pairs of large ones, then best fit."""
    large, small = sorted(s for s in lengths if 3 * s > capacity), sorted((s for s in lengths if 3 * s <= capacity), reverse=True)
    gaps = []
    while large:
        size = large.pop()
        other = max((i for i, s in enumerate(large) if s <= capacity - size), default=None)
        gaps.append(capacity - size - (large.pop(other) if other is not None else 0))
    for size in small:
        fits = [g for g in gaps if g >= size]
        if fits:
            gap = min(fits)
            gaps.remove(gap)
        else:
            gap = capacity
        gaps.append(gap - size)
    return len(gaps)


@pytest.mark.parametrize("seed", range(40))
def test_packing_equals_placing_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, capacity // 3) for _ in range(rng.randint(0, 120))]
    places = packing.pack_counts(dict(Counter(lengths)), capacity)
    used = {first + i // each for _, lo, hi, first, each, _ in places for i in range(hi - lo)}
    assert len(used) == packed_one_by_one(lengths, capacity)


def test_documents_are_packed(spark):
    pytest.importorskip("public_tokenizers")
    rows = ODD + [(i, "word " * i, "z") for i in range(100, 160)]
    got = packing.pack_documents(docs(spark, rows), capacity=128, with_ids=True).collect()
    check_packing([(r["length"], r["sequence_id"], r["offset"]) for r in got], 128)
    assert len({(r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in got}) >= len(got) - 1
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["piece"] == 0 or r["length"] == 128
    for n, want in ((127, [0]), (128, [0, 1]), (256, [0, 1, 129]), (0, [0])):  # ids before the end id
        text = "a" + " a" * (n - 1) if n else None
        one = packing.tokenized_pieces(docs(spark, [(1, text, "z")]), capacity=128).orderBy("piece").collect()
        assert [r["start"] for r in one] == want and sum(r["length"] for r in one) == n + 1


def test_words_get_the_library_s_ids():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoder = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "é", "ñ", "1", "23", "!", "|", "<|endoftext|>", "日", " ", " ", "ß", "İ", "x" * 60, "\x00", "😀", "_", "·", "ª", "²", "'ll", "\r", "thorin."]
    texts = [None, "", " ", "a", " a", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000))]
    flat, ends = encoder.encode(pa.array(texts, pa.string()))
    whole = encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [x.tolist() for x in np.split(flat, ends[:-1])] == [w.ids + [2] for w in whole]
    assert encoder.encode(pa.array([], pa.string()))[0].tolist() == []


def test_encoding_holds_little_and_recalls_words():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoder = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéß") for _ in range(6)) for _ in range(80_000)]
    texts = pa.array([" ".join(rng.choice(words) for _ in range(300)) for _ in range(packing.BATCH_CHARS // 2400)])
    tracemalloc.start()
    flat, ends = encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # of a worker; two of them share an executor with its JVM
    inner, encoded = encoder.words, []
    encoder.words = lambda some: encoded.extend(some) or inner(some)
    again, _ = encoder.encode(texts)
    assert (again == flat).all() and not encoded
    mixed = ["new " + texts[0].as_py(), None, "", "  x  "]
    ids, ends = encoder.encode(pa.array(mixed))
    assert "new" in encoded and len(encoded) < 10  # of 301 words
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in mixed]


def test_mixture_reaches_the_sequences(spark, monkeypatch):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rows = [(i, f"text {i} " + "word " * (i % 37), "a" if i % 4 else "b") for i in range(1200)] + [(None, "twice", "b"), (None, "twice", "b"), (5000, None, None)]
    df = docs(spark, rows)
    source = {i: s for i, _, s in rows}
    heads = {}
    for a, b in ((9, 1), (1, 9)):
        mix = {"weights": {"a": a, "b": b}, "period": 20, "block_rows": 4}
        monkeypatch.setattr(corpus_pipeline, "MIXTURE", mix)
        got = corpus_pipeline.packing(spark, df, "").collect()
        check_packing([(r["length"], r["sequence_id"], r["offset"]) for r in got], packing.CAPACITY)
        assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, _, _ in rows)
        assert {r["sequence_id"] for r in got} == set(range(max(r["sequence_id"] for r in got) + 1))
        mixed = {r["doc_id"]: r["mix_position"] // 100 for r in mixing.mix_sources(df, **mix).collect()}
        got = packing.pack_mixture(df, capacity=128, stretch=100, **mix).where("doc_id is not null").collect()
        by_sequence = sorted({(r["sequence_id"], mixed[r["doc_id"]]) for r in got})
        assert len(by_sequence) == len({s for s, _ in by_sequence}) and [x for _, x in by_sequence] == sorted(x for _, x in by_sequence)
        first = [source[r["doc_id"]] for r in got if mixed[r["doc_id"]] == 0]
        heads[a] = first.count("a") / len(first)
    assert heads[9] > 0.8 and heads[1] < 0.3
    assert packing.pack_mixture(df.limit(0)).count() == 0


def test_pipeline_stages_keep_columns(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rows = ODD + [(i, f"some text number {i} " + "of words " * (i % 9), f"s{i % 3}") for i in range(10, 60)]
    df = docs(spark, rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(10, 40)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == df.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == at.select("doc_id").distinct().count()
    assert at.where(F.col("doc_id") == 3).count() == 0 and at.where("doc_id is null").count() == 1
