import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumberline.llm import hpylm, quality, toxicity
from lumberline.llm.common import WORD


def test_draws_follow_the_enumerated_law():
    def partitions(items):
        if not items:
            yield []
            return
        first, *rest = items
        for p in partitions(rest):
            yield [[first], *p]
            for i in range(len(p)):
                yield [*p[:i], [first, *p[i]], *p[i + 1 :]]

    def exact(n, pull, d):
        weigh = lambda p: pull ** len(p) * math.prod(math.prod(j - d for j in range(1, len(b))) for b in p)
        found = Counter()
        for p in partitions(list(range(n))):
            found[len(p)] += weigh(p)
        return np.array([found[k] / sum(found.values()) for k in range(1, n + 1)])

    keys = np.random.default_rng(1).integers(0, 2**63, 60_000).astype(np.uint64)
    for n, pull in ((2, 0.1), (3, 0.5), (4, 2.0), (6, 1.0)):
        got = hpylm.drawn_tables(keys, np.full(len(keys), n), np.full(len(keys), pull), 0.8, 0)
        assert np.bincount(got, minlength=n + 1)[1:] / len(keys) == pytest.approx(exact(n, pull, 0.8), abs=0.01)


@pytest.mark.parametrize("discount", [0.7, 0.8])
def test_draws_have_one_law_at_all_counts(discount):
    def exact(n, pull):
        weights = np.array([1.0])  # of 1, 2, .. tables, by adding customers one by one
        for m in range(1, n):
            k = np.arange(1, m + 1)
            weights = np.append(weights * (m - discount * k), 0) + np.append(0, weights * pull)
            weights /= weights.sum()
        k = np.arange(1, n + 1)
        mean = (weights * k).sum()
        return mean, math.sqrt((weights * k * k).sum() - mean * mean)

    keys = np.random.default_rng(3).integers(0, 2**63, 6000).astype(np.uint64)
    for n in (24, 60, hpylm.DRAWN, hpylm.DRAWN + 1, 400, 1500):
        for pull in (1e-3, 0.5, 3.0, 40.0, 900.0):
            got = hpylm.drawn_tables(keys, np.full(len(keys), n), np.full(len(keys), pull), discount, 1)
            mean, spread = exact(n, pull)
            assert got.mean() == pytest.approx(mean, rel=0.02) and got.std() == pytest.approx(spread, rel=0.2, abs=0.06), (n, pull)
            assert got.min() >= 1 and got.max() <= n
    huge = hpylm.drawn_tables(keys, np.full(len(keys), 10**12), np.full(len(keys), 1e-7), discount, 0)
    assert huge.max() == 1
    assert hpylm.drawn_tables(keys[:3], np.array([0, 1, 1]), np.ones(3), discount, 0).tolist() == [0, 1, 1]


def test_lm_counts_and_probabilities(spark):
    rng = random.Random(3)
    words = ["Ab", "cd", "ef", "GH", "ij", "klÄ"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["", None, "new words only", " \t\n"]
    rows = [(i if i else None, i % 5 != 0, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, learn boolean, text string")
    got = {(r["id"], r["n_tokens"], round(r["base_score"], 9)): r for r in hpylm.score_texts(df, block_bytes=200).collect()}
    tokens = [[*re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\0"] for t in texts]
    c = Counter(w for (_, learn, _), ws in zip(rows, tokens) if learn for w in ws)
    n, v = sum(c.values()), len(c)
    for (i, _, _), ws in zip(rows, tokens):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        r = got[(i, len(ws), round(base, 9))]
        assert (r["n_known"], r["train_tokens"]) == (sum(c[w] > 0 for w in ws), n)
        assert r["score"] < 0
    assert len(got) == len({(i, len(ws)) for (i, _, _), ws in zip(rows, tokens)})


def lm_tokens(text):
    words = [hpylm.xxhash.xxh64_intdigest(w) & ~1 for w in re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()]
    return [*map(int, words), int(hpylm.END)]


def brute_lm(texts, learn):
    """The sampled model by dictionaries: the log10 probability of each token of each text."""
    tokens = [lm_tokens(t) for t in texts]
    pairs = [list(zip([int(hpylm.START), *ws[:-1]], ws)) for ws in tokens]
    c_word = Counter(w for ws, l in zip(tokens, learn) if l for w in ws)
    c_pair = Counter(p for ps, l in zip(pairs, learn) if l for p in ps)
    c_context = Counter(c for c, _ in c_pair.elements())
    n, v = sum(c_word.values()), len(c_word)
    key = lambda p: int(hpylm.pair_keys(np.array([p[0]], np.uint64), np.array([p[1]], np.uint64))[0])
    draw = lambda k, c, pull, d, s: int(hpylm.drawn_tables(np.array([k], np.uint64), np.array([c]), np.array([pull]), d, s)[0])
    asked = Counter(c_word)
    asked[int(hpylm.START)] = sum(learn)
    tables = {c: asked[c] * len(c_pair) / n for c in asked}
    parent = lambda w: (c_word[w] + 1) / (n + v + 1)
    total, p = v, [np.zeros(len(ps)) for ps in pairs]
    for sweep in range(hpylm.BURN_IN + hpylm.SAMPLES):
        own = {q: draw(key(q), c, (hpylm.STRENGTH + hpylm.DISCOUNT * max(tables.get(q[0], 0) - 1, 0)) * parent(q[1]), hpylm.DISCOUNT, sweep) for q, c in c_pair.items()}
        tables, customers = Counter(), Counter()
        for q, t in own.items():
            tables[q[0]] += t
            customers[q[1]] += t
        pull = (hpylm.ROOT_STRENGTH + hpylm.ROOT_DISCOUNT * (total - 1)) / (v + 1)
        root = {w: draw(w, c, pull, hpylm.ROOT_DISCOUNT, sweep) for w, c in customers.items()}
        total, everyone = sum(root.values()), sum(customers.values())

        def parent(w, root=root, customers=customers, total=total, everyone=everyone):
            return (customers[w] - hpylm.ROOT_DISCOUNT * root.get(w, 0) + (hpylm.ROOT_STRENGTH + hpylm.ROOT_DISCOUNT * total) / (v + 1)) / (hpylm.ROOT_STRENGTH + everyone)

        if sweep >= hpylm.BURN_IN:
            for i, ps in enumerate(pairs):
                p[i] += [(c_pair[q] - hpylm.DISCOUNT * own.get(q, 0) + (hpylm.STRENGTH + hpylm.DISCOUNT * tables[q[0]]) * parent(q[1])) / (hpylm.STRENGTH + c_context[q[0]]) / hpylm.SAMPLES for q in ps]
    return [np.log10(x) for x in p]


@pytest.mark.parametrize("block_bytes", [300, 1 << 20])
def test_lm_scores_equal_brute_force(spark, block_bytes):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ABcdefghijklmnoé") for _ in range(rng.randint(0, 12))) for _ in range(120)] + [None, "", "zzz", "a zzz b", "x\ty\nz"]
    texts += texts[:10] + ["cd " * 900]
    learn = [i % 6 > 0 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(range(len(texts)), learn, texts)), "id bigint, learn boolean, text string").withColumn("score", F.lit("clash"))
    got = {r["id"]: r for r in hpylm.score_texts(df, block_bytes=block_bytes, with_tokens=True).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute_lm(texts, learn)):
        assert got[i]["token_scores"] == pytest.approx(want.tolist(), rel=1e-9)
        assert got[i]["score"] == pytest.approx(want.sum(), rel=1e-9)


def test_lm_probabilities_sum_to_one(spark):
    """The token after each context, over all known words, the end and one unknown word."""
    train = ["a b a c a b", "b a c", "a a b", "c", "b b b b b"]
    words = ["a", "b", "c", "zzz"]
    probes = {(c, w): f"{c} {w}".strip() for c in ["", "a", "b", "c", "other"] for w in [*words, ""]}
    rows = [(i, True, t) for i, t in enumerate(train)] + [(100 + i, False, t) for i, t in enumerate(probes.values())]
    got = {r["id"]: r["token_scores"] for r in hpylm.score_texts(spark.createDataFrame(rows, "id bigint, learn boolean, text string"), with_tokens=True).collect()}
    sums = Counter()
    for i, (c, _) in enumerate(probes):
        sums[c] += 10 ** got[100 + i][1 if c else 0]
    assert dict(sums) == pytest.approx(dict.fromkeys(["", "a", "b", "c", "other"], 1.0))


def test_empty_tables(spark):
    assert hpylm.score_texts(spark.createDataFrame([], "id bigint, learn boolean, text string")).count() == 0
    none = spark.createDataFrame([(1, False, "a b")], "id bigint, learn boolean, text string")
    assert hpylm.score_texts(none).first()["n_known"] == 0
    assert quality.with_statistics(spark.createDataFrame([], "doc_id bigint, lang string, text string"), ["doc_id", "lang"]).count() == 0


def brute_statistics(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dups += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_statistics_equal_brute_force():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab #\n\té") for _ in range(rng.randint(0, 80))) for _ in range(300)] + [None, "", "a b c a b c", "x\nx\n \nx"]
    for t in texts:
        assert quality.statistics(t)[:5] == brute_statistics(t)


def test_binomial_bound_is_exact():
    for k, n, p in ((0, 50, 0.02), (3, 200, 0.05), (10, 100, 0.2)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert quality.certified_rung([0, 0, 50], 1000, 0.01, 0.05) == 1
    assert quality.certified_rung([0], 10, 0.01, 0.05) == -1


def quantile(values, q):
    ordered = sorted(values)
    return ordered[max(0, math.ceil(q * len(ordered)) - 1)]


def brute_accepted(spark, rows, labels, alpha, delta):
    """``risk_controlled`` for (doc_id, lang, unit, statistics), by lists and loops."""
    rules = {
        "symbols": lambda s: s[2] / max(s[1], 1),
        "dup_lines": lambda s: s[3] / max(s[5], 1),
        "repeats": lambda s: s[4] / max(s[0], 1),
        "word_length": lambda s: s[1] / max(s[0], 1),
    }
    units = {}
    for i, lang, unit, s in rows:
        if i in labels and s[0] >= 50 and 100 * s[4] <= 50 * s[0]:
            known = units.setdefault((lang, unit), [False, [f(s) for f in rules.values()]])
            known[0] |= labels[i] > 0
    hashes = {u: h for u, h in spark.createDataFrame([(str(u),) for _, u in units], "u string").select("u", F.pmod(F.xxhash64(F.lit(9), "u"), F.lit(2))).collect()}
    tune = [(lang, good, x) for (lang, u), (good, x) in units.items() if hashes[str(u)] == 0]
    held = [(lang, good, x) for (lang, u), (good, x) in units.items() if hashes[str(u)] == 1]
    edges = [sorted({quantile([x[k] for _, good, x in tune if good], q) for q in quality.BINS}) for k in range(4)]
    of = lambda k, v: sum(v > e for e in edges[k])
    value = []
    for k in range(4):
        counts = {g: Counter(of(k, x[k]) for _, good, x in tune if good == g) for g in (True, False)}
        value.append([math.log((counts[False][b] + 0.5) / (sum(counts[False].values()) + 1)) - math.log((counts[True][b] + 0.5) / (sum(counts[True].values()) + 1)) for b in range(len(edges[k]) + 1)])
    score = lambda x: round(sum(value[k][of(k, x[k])] for k in range(4)), 6)
    strata = {lang for lang, good, _ in tune if good}
    cutoff = {}
    for lang in strata:
        good = [score(x) for s, g, x in tune if s == lang and g]
        bad = [score(x) for s, g, x in tune if s == lang and not g]
        out = [score(x) for s, g, x in held if s == lang and g]
        cuts = [quantile(good, 1 - q) for q in quality.LADDER]
        last = -1
        for c in cuts:
            lost = sum(x > c for x in out)
            if not out or lost > len(out) * alpha or sum(math.comb(len(out), j) * alpha**j * (1 - alpha) ** (len(out) - j) for j in range(lost + 1)) > delta / len(strata):
                break
            last += 1
        worth = [sum(x > c for x in bad) / max(1, len(bad)) - sum(x > c for x in good) / len(good) for c in cuts[: last + 1]]
        if worth:
            cutoff[lang] = cuts[worth.index(max(worth))]
    return [lang not in cutoff or score([f(s) for f in rules.values()]) <= cutoff[lang] for _, lang, _, s in rows]


def test_rules_keep_good_documents(spark):
    rng = random.Random(7)
    rows, labels = [], {}
    for i in range(4000):
        good = i % 4 > 0
        text = " ".join(rng.choice("abcdefgh") * rng.randint(2, 7) + ("" if good else "%%%") * (rng.random() < 0.5) for _ in range(rng.randint(45, 80)))
        lang = None if i % 8 < 4 else "en" if i % 16 < 12 else "x"
        if i % 3 == 0 and rows:  # a copy
            lang, text, good = rows[-1][1], rows[-1][2], labels[i - 1] > 0
        rows.append((i, lang, text))
        labels[i] = int(good if rng.random() < 0.99 else not good)
    rows += [(None, "en", "a %"), (4000, "en", None), (4001, "new", rows[0][2]), (3999, "en", rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").withColumn("unit", F.xxhash64("text"))
    known = spark.createDataFrame([*labels.items(), (None, 1), (4001, None)], "doc_id bigint, quality int")
    scored = quality.with_statistics(docs, ["doc_id", "lang", "unit"])
    for alpha in (0.05, 0.02):
        judged = quality.risk_controlled(scored, known, eligible=f"not ({quality.BASE_FAILED})", alpha=alpha).collect()
        stats = [(r["doc_id"], r["lang"], r["unit"], tuple(r[n] for n in quality.NAMES)) for r in judged]
        assert [r["accepted"] for r in judged] == brute_accepted(spark, stats, labels, alpha, quality.DELTA)
    caught = sum(not r["accepted"] for r in judged if r["doc_id"] in labels and not labels[r["doc_id"]])
    lost = sum(not r["accepted"] for r in judged if r["doc_id"] in labels and labels[r["doc_id"]])
    assert caught > 500 and lost < 60
    few = quality.risk_controlled(scored, known.where("doc_id < 20"))
    assert few.where("not accepted").count() == 0
    assert quality.risk_controlled(scored, known.limit(0)).where("accepted").count() == len(rows)
    assert quality.risk_controlled(scored.limit(0), known).count() == 0
    again = quality.risk_controlled(scored.withColumn("accepted", F.lit("x")).withColumn("a.b", F.lit(1)), known)
    assert dict(again.dtypes)["accepted"] == "boolean" and "a.b" in again.columns
    with pytest.raises(ValueError):
        quality.with_statistics(docs.withColumn("n_words", F.lit(1)), ["doc_id", "n_words"])


def test_chosen_rung():
    assert quality.chosen_rung(2, [0, 5, 5, 9], 10, [0, 1, 2, 3], 100) == 1
    assert quality.chosen_rung(1, [0, 0], 0, [0, 0], 0) == 0


def kernel(a, b):
    """The subsequence kernel by its definition."""

    def weights(s):
        out = Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    out[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    x, y = weights(a), weights(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(x[t] * y[t] for t in x) / norm if norm else 0.0


def test_kernel_equals_its_definition():
    strings = ["^idiot$", "^idxiot$", "^hahaha$", "^worthless$", "^abc$", "^banana$", "^ananab$", "^réeuxê$", "^réeuxè$", "^日本語$"]
    want = {(i, j): k for i, s in enumerate(strings) for j, m in enumerate(strings[:4] + strings[7:]) if (k := kernel(s, m)) >= toxicity.FLOOR}
    found = dict(((i, j), k) for i, j, k in zip(*(x.tolist() for x in toxicity.Landmarks(strings[:4] + strings[7:]).near(strings))))
    assert found == pytest.approx(want, abs=1e-5)
    assert (1, 0) in found and (8, 4) in found and (5, 2) not in found


def brute_score(model, text):
    """The machine by its definition: every string of the text against every landmark."""
    tokens = set((text or "").lower().split()) | {toxicity._OTHER.sub("", m.group()).lower() for m in toxicity._SPELLED.finditer(text or "")}
    n, m = len(tokens), len(model.marks)
    total, largest = [0.0] * m, [0.0] * m
    for token in tokens:
        for j, mark in enumerate(model.marks):
            k = max((kernel(s, mark) for s in toxicity.strings_of(token)), default=0.0)
            t = (k - toxicity.FLOOR) / (1 - toxicity.FLOOR) if k >= toxicity.FLOOR else 0.0
            total[j] += t
            largest[j] = max(largest[j], t)
    x = [*(t / math.sqrt(n + 10) for t in total), *(v / 2 for v in largest), math.sqrt(n) / 20, 1.0]
    d = sum(a * b for a, b in zip(x, model.coefficients))
    d = d if any(largest) else min(d, -1.0)
    return 1 / (1 + math.exp(-(model.slope * d + model.offset)))


def test_toxicity_tells_words_and_disguises(spark):
    rng = random.Random(11)
    syllables = ["an", "the", "ou", "re", "st", "ing", "ble", "or", "ly", "ha"]
    plain = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(30))
    bad = ["idiot", "worthless", "pathetic"]
    rows = [(plain() + (f" you {rng.choice(bad)} " + plain() if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(1500)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label bigint"))
    texts = ["an idiot", "an i d i o t", "id-iot!", "you,idiot", "worthlesss", "the patthetic", "the idxiot"]
    hits = model.scores(texts)
    clean = [plain() for _ in range(100)] + ["", None]
    assert min(hits) >= toxicity.THRESHOLD > max(model.scores(clean))
    odd = [*texts, *clean, "\x00 idiot", "日本語 idiot", "idiot " * 3000 + plain() * 200]
    assert model.scores(odd) == pytest.approx([brute_score(model, t) for t in odd], abs=1e-5)
    df = spark.createDataFrame([("idiot", 1.5, None), (None, None, "x"), ("idiot", 1.5, None)], "text string, score double, `a b` string")
    out = toxicity.with_scores(df, model).collect()
    assert [r["score"] >= 0.3 for r in out] == [True, False, True] and out[1]["a b"] == "x"
    assert toxicity.with_scores(df.limit(0), model).count() == 0


def test_copies_are_one_training_text(spark):
    rows = [("a much copied text", 0)] * 500 + [(f"other text {i}", i % 2) for i in range(40)] + [(None, 1), ("", 0), ("x", None)]
    sample = toxicity.training_texts(spark.createDataFrame(rows, "text string, label bigint"), 10, 12, 5).collect()
    assert len({r["text"] for r in sample}) == len(sample)
    assert sum(r["label"] for r in sample) == 10 and len(sample) == 22


def test_toxicity_without_labels(spark):
    model = toxicity.fit(spark.createDataFrame([("a b", 0)], "text string, label bigint"))
    assert model.scores(["a", None])[0] < toxicity.THRESHOLD
    assert toxicity.fit(spark.createDataFrame([], "text string, label bigint")).scores(["idiot"])[0] < toxicity.THRESHOLD
    assert toxicity.fit(spark.createDataFrame([("a b", None), (None, 1)], "text string, label bigint")).scores([None])[0] < toxicity.THRESHOLD


def test_blocks_of_odd_texts_like_plain_python():
    texts = ["", None, "\x0b A b\x0c\rB É \x85x　y  ", " lead", "trail ", "\udc80a B", "a b a b a"] + [f"w{i % 7} W{i % 5}" for i in range(50)]
    sizes, keys, tokens = hpylm.coded(texts)
    plain = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    assert sizes.tolist() == [len(p) + 1 for p in plain]
    key = lambda w: hpylm.xxhash.xxh64_intdigest(w) & ~1
    assert keys[tokens].tolist() == [k for p in plain for k in [*map(key, p), int(hpylm.END)]]
    block = hpylm.Pairs(sizes, keys, tokens, None)
    pairs = [(a, b) for p in plain for a, b in zip([int(hpylm.START), *map(key, p)], [*map(key, p), int(hpylm.END)])]
    assert list(zip(keys[block.pair_context][block.pair_of].tolist(), keys[block.pair_word][block.pair_of].tolist())) == pairs
    assert len(block.pairs) == len(set(pairs)) and (np.diff(block.pairs.astype(object)) > 0).all()
    again = hpylm.Pairs(sizes, keys, tokens, block.first)
    assert (again.pairs == block.pairs).all() and (again.pair_word == block.pair_word).all()


def test_numbers_are_packed_without_empty_planes():
    for values in ([], [0], [0, 255], [256, 3], [2**63, 2**64 - 1, 0]):
        assert hpylm.unsqueezed(hpylm.squeezed(np.array(values, np.uint64))).tolist() == values
    noise = np.random.default_rng(1).integers(0, 256, 1_000)
    assert hpylm.squeezed(noise)[-9] == 1


def test_stored_blocks_keep_their_pairs(spark):
    texts = ["a b a b c", None, "", "c A b", "b a b a"] + [f"w{i % 7} a W{i % 5} b" for i in range(60)]
    rows = [(i, i % 3 > 0, t) for i, t in enumerate(texts)]
    stored = hpylm.in_blocks(spark.createDataFrame(rows, "id bigint, learn boolean, text string").coalesce(1), 300).toArrow()
    key = lambda w: hpylm.xxhash.xxh64_intdigest(w.encode()) & ~1
    found = []
    for i in range(stored.num_rows):
        block = hpylm.Block(stored.slice(i, 1))
        ids, sizes = block.one("ids"), hpylm.unsqueezed(block.one("sizes")).astype(np.int64)
        found += ids
        plain = [[*map(key, (texts[j] or "").lower().split()), int(hpylm.END)] for j in ids]
        pairs = [list(zip([int(hpylm.START), *p], p)) for p in plain]
        assert sizes.tolist() == [len(p) for p in plain]
        there = list(zip(block.words[block.contexts].tolist(), block.words[block.seconds].tolist()))
        of_token = hpylm.unsqueezed(block.one("pair_of")).tolist()
        assert [there[k] for k in of_token] == [q for p in pairs for q in p] and len(set(there)) == len(there)
        keys, word_at, pair_at = block.keys()
        assert (np.diff(keys.astype(object)) > 0).all() and len(keys) == len(block.words) + len(there)
        assert (keys[word_at] == block.words).all() and (keys[pair_at] == block.pairs()).all()
        own, learn = hpylm.unsqueezed(block.one("own")), block.one("learn")
        assert dict(zip(there, own[pair_at].tolist())) == {q: sum(p.count(q) for p, w in zip(pairs, learn) if w) for q in there}
        counted = {k: sum(p.count(k) for p, w in zip(plain, learn) if w) for k in block.words.tolist()} | {int(hpylm.START): sum(learn)}
        assert dict(zip(block.words.tolist(), own[word_at].tolist())) == counted
    assert stored.num_rows > 1 and sorted(found) == list(range(len(texts)))


def test_dishes_are_ordered_once_for_all_draws():
    rng = np.random.default_rng(5)
    customers = np.r_[0, 1, 2, 16, 17, hpylm.DRAWN, hpylm.DRAWN + 1, 5000, rng.integers(0, 300, 3000)]
    keys, dishes = rng.integers(0, 2**63, len(customers)).astype(np.uint64), hpylm.Dishes(customers)
    for sweep in range(3):
        pull = rng.uniform(1e-3, 30, len(customers))
        got = dishes.drawn(keys[dishes.several], pull[dishes.several], 0.8, sweep)
        alone = [int(hpylm.drawn_tables(keys[i : i + 1], customers[i : i + 1], pull[i : i + 1], 0.8, sweep)[0]) for i in range(len(keys))]
        assert got.tolist() == alone
    assert hpylm.Dishes(np.array([0, 1, 1])).drawn(keys[:0], np.zeros(0), 0.8, 0).tolist() == [0, 1, 1]
