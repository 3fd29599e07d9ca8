"""Scoring of texts by a hierarchical Pitman-Yor bigram model of the corpus.

Each word that occurs as a context has a restaurant whose dishes are the words after it; all these restaurants share the
unigram restaurant as their parent: each of their tables is one customer there. A sweep of blocked Gibbs sampling seats
the customers of every dish of every restaurant anew, given the tables of its restaurant and the parent's probability of
the dish after the sweep before; then the parent's customers, given its own tables. A text's probability is the mean of
each token's predictive probabilities over the samples.

Counts never become rows. Texts lie in blocks of some megabytes, as numbers of the block's distinct word pairs, which are
found once and lie beside them by context and word; sweeps read the pairs alone, not the texts. A block sends its sorted
distinct keys (hashes of words and of word pairs), packed, to reducers by ranges of the key; these answer with the corpus
counts in the same order, and name one block as the owner of each key. Draws for a pair follow from its counts, its
restaurant's state and a generator seeded by its key, so every block draws the same; in each sweep owners add up the
tables by context and by word, and an exchange of these sums (words only) gives the next state. There are at most as many
messages as blocks times ranges, and as keys.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import chain
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, drop_spool, n_partitions, spool

BLOCK_BYTES = 4 << 20
#: Blocks whose keys, about, one range of keys amounts to.
BLOCKS_PER_RANGE = 2
#: Blocks that a bucket of them has, about (a task reads one bucket), and buckets at most.
BLOCKS_PER_BUCKET, MOST_BUCKETS = 8, 50_000
#: Discount and strength of the context restaurants, and of the unigram restaurant.
DISCOUNT, STRENGTH = 0.8, 1.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.7, 1.0
#: Sweeps whose probabilities are averaged, and sweeps left out before them.
SAMPLES, BURN_IN = 3, 1
#: Up to so many customers of a dish, tables are drawn from the tabulated law; above, from a Poisson or normal law of the
#: same mean and variance (the table would grow with the square of the customers).
DRAWN = 128
#: Up to so many, the law's weights are products of powers, which stay far from the ends of doubles, and need no logarithms.
POWERED = 16
START = np.uint64(xxhash.xxh64_intdigest(b"\x00start") & ~1)
END = np.uint64(xxhash.xxh64_intdigest(b"\x00end") & ~1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One key for each (context, word); the lowest bit is 1, that of a word's key 0."""
    return mixed(contexts * np.uint64(0x9E3779B97F4A7C15) + words) | np.uint64(1)


# Seatings


class Dishes:
    """The customers of dishes, those of several customers by their number: made once for all draws over them."""

    def __init__(self, customers: np.ndarray):
        self.single = np.minimum(customers, 1).astype(np.int64)
        several = np.flatnonzero(customers > 1)
        # bytes are sorted by counting
        self.several = several[np.argsort(np.minimum(customers[several], DRAWN + 1).astype(np.uint8), kind="stable")]
        self.customers = customers[self.several]
        self.few = int(np.searchsorted(self.customers, DRAWN, "right"))
        self.edges = np.r_[0, np.flatnonzero(np.diff(self.customers[: self.few])) + 1, self.few].tolist() if self.few else [0]

    def drawn(self, keys: np.ndarray, pull: np.ndarray, discount: float, sweep: int) -> np.ndarray:
        """A draw of the number of tables that serve each dish; ``keys`` and ``pull`` are those of the ``several`` alone.

        ``pull`` is the weight of a new table: (strength + discount * tables) * the parent's probability of the dish. The law
        is the one that single Gibbs steps tend to while ``pull`` stands: pull ** tables times the generalised Stirling
        number. One customer sits at one table.
        """
        offset = np.uint64((sweep + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        draw = (mixed(keys + offset) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        found = np.ones(len(self.several), np.int64)
        for lo, hi in zip(self.edges[:-1], self.edges[1:]):
            n = int(self.customers[lo])
            law = log_stirling(discount)[n, 1 : n + 1]
            step = 65536 if n <= POWERED else 8192
            for i in range(lo, hi, step):
                some = slice(i, min(i + step, hi))
                here = pull[some]
                if n <= POWERED:
                    weight, power, total, upto = np.exp(law), np.ones(len(here)), np.zeros(len(here)), []
                    for k in range(n):
                        total = total + weight[k] * power
                        upto.append(total)
                        power = power * here
                    target = draw[some] * total
                    for x in upto[:-1]:
                        found[some] += x <= target
                    continue
                if here.max() < 10 ** (290 / n):  # the powers stay below the largest double
                    share = np.ones((len(here), n))
                    share[:, 1:] = here[:, None]
                    share = (share.cumprod(axis=1) * np.exp(law - law[0])).cumsum(axis=1)
                else:
                    weight = law + np.arange(n) * np.log(here)[:, None]
                    share = np.exp(weight - weight.max(axis=1, keepdims=True)).cumsum(axis=1)
                found[some] = 1 + (share[:, :-1] <= draw[some, None] * share[:, -1:]).sum(axis=1)
        many = slice(self.few, None)
        mean, variance = _moments(self.customers[many], pull[many], discount)
        found[many] = np.clip(1 + _quantile(draw[many], mean, variance), 1, self.customers[many])
        tables = self.single.copy()
        tables[self.several] = found
        return tables


def drawn_tables(keys: np.ndarray, customers: np.ndarray, pull: np.ndarray, discount: float, sweep: int) -> np.ndarray:
    """One draw of the tables that serve each dish to its ``customers``, see ``Dishes``."""
    dishes = Dishes(customers)
    return dishes.drawn(keys[dishes.several], pull[dishes.several], discount, sweep)


_grids: dict[float, tuple[np.ndarray, np.ndarray]] = {}
_PULLS, _CUSTOMERS = np.arange(-4.0, 10.01, 0.125) * math.log(10), np.arange(math.log(DRAWN), math.log(1e13), math.log(2) / 2)


def _moments(customers: np.ndarray, pull: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables beyond the first, for more than ``DRAWN`` customers: interpolated on a grid of the
    logarithms of both arguments, and carried on in a line below it (tiny pulls), where both grow with the pull."""
    if discount not in _grids:
        n, p = (x.ravel() for x in np.meshgrid(np.exp(_CUSTOMERS), np.exp(_PULLS), indexing="ij"))
        mean = np.concatenate([expected_tables(n[i : i + 2048], p[i : i + 2048], discount) for i in range(0, len(n), 2048)]).reshape(len(_CUSTOMERS), len(_PULLS)) - 1
        variance = np.gradient(mean, _PULLS, axis=1)  # the slope of the mean by the logarithm of the pull
        mean, variance = np.maximum(mean, 1e-12), np.maximum(variance, 1e-12)
        _grids[discount] = np.log(mean), np.log(variance)
    u = np.clip((np.log(customers) - _CUSTOMERS[0]) / (_CUSTOMERS[1] - _CUSTOMERS[0]), 0, len(_CUSTOMERS) - 1.001)
    v = np.minimum((np.log(pull) - _PULLS[0]) / (_PULLS[1] - _PULLS[0]), len(_PULLS) - 1.001)
    i, j = u.astype(np.int64), np.maximum(v, 0).astype(np.int64)
    u, v = u - i, v - j
    mean, variance = (np.exp((1 - u) * ((1 - v) * g[i, j] + v * g[i, j + 1]) + u * ((1 - v) * g[i + 1, j] + v * g[i + 1, j + 1])) for g in _grids[discount])
    return mean, variance


def _quantile(u: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Whole numbers at the quantiles ``u``: of a Poisson law up to a mean of 30, of a rounded normal one above."""
    out, large = np.zeros(len(u)), np.flatnonzero(mean > 30)
    out[large] = np.rint(mean[large] + np.sqrt(variance[large]) * np.fromiter(map(NormalDist().inv_cdf, u[large].tolist()), np.float64, len(large)))
    small = np.flatnonzero(mean <= 30)
    term = np.exp(-mean[small])
    total, k = term.copy(), np.zeros(len(small))
    for i in range(1, 120):
        more = u[small] > total
        if not more.any():
            break
        term = term * mean[small] / i
        total += term
        k += more
    out[small] = k
    return np.maximum(out, 0).astype(np.int64)


_stirling: dict[float, np.ndarray] = {}


def log_stirling(discount: float) -> np.ndarray:
    """Row n, column k: the logarithm of the summed weights of the seatings of n customers at k tables, to ``DRAWN``."""
    if discount not in _stirling:
        out = np.full((DRAWN + 1, DRAWN + 2), -np.inf)
        out[1, 1] = 0
        for n in range(1, DRAWN):
            k = np.arange(1, n + 2)
            out[n + 1, k] = np.logaddexp(out[n, k - 1], out[n, k] + np.log(n - discount * np.minimum(k, n)))
        _stirling[discount] = out
    return _stirling[discount]


def expected_tables(customers: np.ndarray, pull: np.ndarray, discount: float, nodes: int = 48) -> np.ndarray:
    """The mean over all seatings, without their number growing into the work.

    The summed weights of all seatings of n customers are n! times the nth coefficient of exp(h(z)), with h(z) = pull *
    (1 - (1 - z) ** discount) / discount; with the factor h(z) besides, they are those weights times the tables. Both
    coefficients are integrals over z = exp(-s), along a parabola through the saddle point; their quotient is the mean.
    """
    n, pull = customers.astype(np.float64)[:, None], pull[:, None]
    lo, hi = np.full_like(n, -60.0), np.maximum(4.0, np.log(np.log1p(pull / n) + 3))
    for _ in range(50):
        middle = (lo + hi) / 2
        s = np.exp(middle)
        low = np.log(pull) - s + (discount - 1) * np.log(-np.expm1(-s)) > np.log(n)
        lo, hi = np.where(low, middle, lo), np.where(low, hi, middle)
    saddle = np.maximum(np.exp(lo), 4 / n)
    z, q = np.exp(-saddle), -np.expm1(-saddle)
    curve = pull * z * q ** (discount - 1) * (1 + (1 - discount) * z / q)
    width = np.minimum(np.minimum(1 / (2 * saddle * np.sqrt(curve)), 1 / np.sqrt(n * saddle)), 0.45)
    direction = 1 + 0.25j * width * (np.arange(nodes) + 0.5)
    s = saddle * direction**2
    h, top = pull * (1 - (-np.expm1(-s)) ** discount) / discount, pull * (1 - q**discount) / discount
    # the constant 1 of exp(h) has no nth coefficient: leaving it out keeps small pulls exact
    small = top < 30
    whole = np.where(small, np.expm1(np.where(small, h, 0)) * np.exp(-np.where(small, top, 0)), np.exp(np.where(small, 0, h - top)))
    path = np.exp(n * (s - saddle)) * direction
    mean = (h * np.exp(h - top) * path).real.sum(axis=1) / (whole * path).real.sum(axis=1)
    return np.clip(mean, 1.0, customers)


# Blocks and messages


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers of at least 0 in planes of bytes, compressed: planes that hardly vary take next to nothing."""
    planes = values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    used = (int(values.max(initial=0)).bit_length() + 7) // 8 or 1  # those above are left out
    raw = b"".join([planes[:, i].tobytes() for i in range(used)])  # one by one: copied faster than all at once
    return pa.compress(raw, codec="zstd", asbytes=True) + bytes([used]) + len(values).to_bytes(8, "little")


def unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[-8:], "little")
    if not n:
        return np.zeros(0, np.uint64)
    used = data[-9]
    raw = np.frombuffer(pa.decompress(memoryview(data)[:-9], used * n, codec="zstd"), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    for i in range(used):
        out[:, i] = raw[i * n : (i + 1) * n]
    return out.view("<u8").ravel()


def squeezed_keys(keys: np.ndarray) -> bytes:
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def unsqueezed_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(data), dtype=np.uint64)


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, sorted keys of the distinct words, the place of each token's word among them); each text
    ends with the end, and the start is among the words."""
    raw = pa.array([(t or "").encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()).view(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(raw))  # A-Z only
    words = lists.flatten()
    there = pc.greater(pc.binary_length(words), 0)  # empty ones stand beside white space at the ends of a text
    upto = np.r_[0, np.cumsum(there.to_numpy(zero_copy_only=False))]
    sizes = np.diff(upto[lists.offsets.to_numpy()]).astype(np.int64)
    found = words.filter(there).view(pa.large_binary()).dictionary_encode()
    distinct_words = found.dictionary.to_numpy(zero_copy_only=False)  # bytes without a scalar of Arrow for each
    hashes = np.r_[np.fromiter(map(xxhash.xxh64_intdigest, distinct_words), np.uint64, len(distinct_words)), START, END] & ~np.uint64(1)
    keys, place = np.unique(hashes, return_inverse=True)
    tokens = np.insert(found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes), len(hashes) - 1)
    return sizes + 1, keys, place[tokens]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, in the order of the keys; the number of each place's key among them). Which of its places
    a key gets is open, so that the sort needn't be stable, which takes several times as long."""
    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.r_[np.ones(min(1, len(keys)), bool), ordered[1:] != ordered[:-1]]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(starts) - 1
    return order[starts], number


def interleaved(words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted list of two sorted lists without common keys, and the places of their keys in it."""
    word_at = np.searchsorted(pairs, words) + np.arange(len(words))
    others = np.ones(len(words) + len(pairs), bool)
    others[word_at] = False
    pair_at = np.flatnonzero(others)
    keys = np.empty(len(others), np.uint64)
    keys[word_at], keys[pair_at] = words, pairs
    return keys, word_at, pair_at


class Pairs:
    """The distinct pairs of a block's tokens, found again from the place of one token of each, and the sorted list of
    the distinct keys of both levels."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, tokens: np.ndarray, first: np.ndarray | None):
        self.sizes, self.words, self.tokens, self.ends = sizes, words, tokens, np.cumsum(sizes)
        self.start = int(np.searchsorted(words, START))
        contexts = np.empty_like(tokens)
        contexts[1:] = tokens[:-1]
        contexts[np.r_[0, self.ends[:-1]]] = self.start
        if first is None:
            first, self.pair_of = distinct(pair_keys(words[contexts], words[tokens]))
        self.first, self.pair_context, self.pair_word = first, contexts[first], tokens[first]
        self.pairs = pair_keys(words[self.pair_context], words[self.pair_word])
        self.keys, self.word_at, self.pair_at = interleaved(words, self.pairs)

    def own_counts(self, learn: np.ndarray) -> np.ndarray:
        """How often each key occurs in the texts that are learnt from; the start counts texts."""
        learnt = np.repeat(learn, self.sizes)
        out = np.zeros(len(self.keys), np.int64)
        out[self.word_at] = np.bincount(self.tokens[learnt], minlength=len(self.words))
        out[self.word_at[self.start]] = learn.sum()
        out[self.pair_at] = np.bincount(self.pair_of[learnt], minlength=len(self.pairs))
        return out


    def by_context(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, word) of each pair in that order, in which contexts take next to no room, and the number of each
        token's pair in it."""
        order = np.argsort(self.pair_context * len(self.words) + self.pair_word)
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        return self.pair_context[order], self.pair_word[order], number[self.pair_of]


class Block:
    """What rounds need of a block: its words, and its distinct pairs by context and word."""

    def __init__(self, t: pa.Table):
        self.one = lambda c: t.column(c)[0].as_py()
        self.g, self.words = self.one("g"), unsqueezed_keys(self.one("words"))
        self.contexts = np.cumsum(unsqueezed(self.one("contexts")).astype(np.int64))
        self.seconds = unsqueezed(self.one("seconds")).astype(np.int64)

    def pairs(self, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        return pair_keys(self.words[self.contexts[some]], self.words[self.seconds[some]])

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted keys of both levels, and the places of the words and of the pairs among them."""
        pairs = self.pairs()
        order = np.argsort(pairs)
        keys, word_at, at = interleaved(self.words, pairs[order])
        pair_at = np.empty_like(at)
        pair_at[order] = at
        return keys, word_at, pair_at


BLOCK = "g bigint, ids array<bigint>, learn array<boolean>, sizes binary, words binary, contexts binary, seconds binary, pair_of binary, own binary"
MESSAGE = "g bigint, r int, keys binary, a binary, b binary, c binary"
_TYPES = {"g": pa.int64(), "r": pa.int32(), "keys": pa.binary(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}


def messages(g: int, parts: list[tuple]) -> pa.Table:
    rows = [(g, *p, *[None] * (5 - len(p))) for p in parts]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(_TYPES.items())})


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    edges = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def in_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """The rows of ``docs`` (id, learn, text) in blocks, one row each; a text is whole in one block."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, learn, texts = (list(chain.from_iterable(b.column(i).to_pylist() for b in held)) for i in range(3))
            held.clear()
            sizes, words, tokens = coded(texts)
            block = Pairs(sizes, words, tokens, None)
            own = block.own_counts(np.array(learn, bool))
            contexts, seconds, pair_of = block.by_context()
            g = uuid.uuid4().int >> 66  # drawn once: the blocks are written before anything reads them
            packed = {"sizes": sizes, "words": np.diff(words, prepend=np.uint64(0)), "contexts": np.diff(contexts, prepend=0), "seconds": seconds, "pair_of": pair_of, "own": own}
            row = {"g": pa.array([g], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "learn": pa.array([learn], pa.list_(pa.bool_()))}
            row |= {name: pa.array([squeezed(values)], pa.binary()) for name, values in packed.items()}
            return pa.RecordBatch.from_arrays(list(row.values()), list(row))

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                held.append(part)
                size += part.nbytes
                if size >= block_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.select("id", "learn", "text").mapInArrow(gather, BLOCK)


def merged(t: pa.Table) -> tuple[list[tuple[int, slice]], np.ndarray, np.ndarray, np.ndarray]:
    """Senders with their stretches, the distinct keys, the place of each sent key, and one sending of each key."""
    every = [unsqueezed_keys(x.as_py()) for x in t.column("keys")]
    ends = np.cumsum([len(x) for x in every]).tolist()
    together = np.concatenate(every)
    one, place = distinct(together)
    return [(g, slice(e - len(x), e)) for g, e, x in zip(t.column("g").to_pylist(), ends, every)], together[one], place, one


def sent(t: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([unsqueezed(x.as_py()) for x in t.column(column)]).astype(np.float64)


def totals_of(df: DataFrame, n: int) -> list[int]:
    """Sums over the reducers' totals; one short row for each reducer."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [unsqueezed(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(n)], [f"c{i}" for i in range(n)])

    found = df.where("g = -1").select("a").mapInArrow(unpack, ", ".join(f"c{i} bigint" for i in range(n)))
    return list(found.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)) for i in range(n)]).first())


def score_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES, with_tokens: bool = False) -> DataFrame:
    """(id, learn, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (id, learn, text).

    The model learns from all rows with ``learn``; ``score`` is the log10 probability of the text's words and its end,
    ``base_score`` that of an add-one unigram model; ``with_tokens`` adds the log10 probability of each token. Null texts
    count as empty: they have the end alone. Null ids and repeated rows are kept, each row is learnt from. Other columns
    are not looked at. An empty table gives an empty result; with nothing learnt every token has the one probability there
    is. A text of any length is one block's: it must fit a task's memory.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(8, n_partitions(spark), -(-size // (BLOCKS_PER_BUCKET * block_bytes))))
    blocks = bucketed(in_blocks(docs, block_bytes), "g", buckets)
    ranges = max(n_partitions(spark), -(-blocks.select("g").count() // BLOCKS_PER_RANGE))

    def send_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(pa.Table.from_batches([batch.slice(i, 1)]))
                keys, own = block.keys()[0], unsqueezed(block.one("own"))
                at = cuts(keys, ranges)
                for lo in range(0, ranges, 64):
                    parts = [(r, squeezed_keys(keys[at[r] : at[r + 1]]), squeezed(own[at[r] : at[r + 1]])) for r in range(lo, min(lo + 64, ranges)) if at[r] < at[r + 1]]
                    yield from messages(block.g, parts).to_batches()

    def add_counts(t: pa.Table) -> pa.Table:
        senders, keys, place, one = merged(t)
        r = t.column("r")[0].as_py()
        count = np.bincount(place, sent(t, "a")).astype(np.int64)
        owner = np.zeros(len(place), bool)
        owner[one] = True
        out = [messages(g, [(r, None, squeezed(count[place[some]]), np.packbits(owner[some]).tobytes())]) for g, some in senders]
        word = (keys & np.uint64(1) == 0) & (count > 0) & (keys != START)
        pair = (keys & np.uint64(1) == 1) & (count > 0)
        return pa.concat_tables([*out, messages(-1, [(r, None, squeezed(np.array([count[word].sum(), word.sum(), pair.sum()])))])])

    sending = blocks.select("g", "words", "contexts", "seconds", "own")
    counts = spool(sending.mapInArrow(send_counts, MESSAGE).groupBy("r").applyInArrow(add_counts, MESSAGE))
    n_train, n_words, n_pairs = totals_of(counts, 3)

    def keep_counts(_key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        """The corpus counts of a block's words and pairs, and which of the pairs it owns."""
        order = np.argsort(answers.column("r").to_numpy())
        count = np.concatenate([unsqueezed(answers.column("a")[i].as_py()) for i in order.tolist()])
        n = [int.from_bytes(answers.column("a")[i].as_py()[-8:], "little") for i in order.tolist()]
        owner = np.concatenate([np.unpackbits(np.frombuffer(answers.column("b")[i].as_py(), np.uint8), count=k) for i, k in zip(order.tolist(), n)])
        block = Block(blocks)
        _, word_at, pair_at = block.keys()
        kept = {"c_word": squeezed(count[word_at]), "c_pair": squeezed(count[pair_at]), "owner": np.packbits(owner[pair_at]).tobytes()}
        return pa.table({"g": pa.array([block.g], pa.int64())} | {name: pa.array([values], pa.binary()) for name, values in kept.items()})

    of_pairs = blocks.select("g", "words", "contexts", "seconds")
    known_counts = bucketed(of_pairs.groupBy("g").cogroup(counts.where("g >= 0").groupBy("g")).applyInArrow(keep_counts, "g bigint, c_word binary, c_pair binary, owner binary"), "g", buckets)
    drop_spool(counts)
    ready = blocks.join(known_counts.hint("merge"), "g")  # both lie in buckets: nothing is shuffled

    def loaded(t: pa.Table) -> tuple[Block, np.ndarray, np.ndarray]:
        block = Block(t)
        return block, *(unsqueezed(block.one(c)).astype(np.int64) for c in ("c_word", "c_pair"))

    known: list[tuple[int, int]] = []  # of each sweep: customers and tables of the parent

    def state(c_word: np.ndarray, answers: pa.Table | None, sweep: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the block's words after ``sweep``: the tables of the restaurant of each, and the parent's probability."""
        if sweep < 0:  # before the first: an add-one model, and as many tables as distinct pairs on average
            return c_word * (n_pairs / max(1, n_train)), (c_word + 1) / (n_train + n_words + 1)
        rows = answers.filter(pc.equal(answers.column("sweep"), sweep))
        order = np.argsort(rows.column("r").to_numpy()).tolist()
        of = lambda c: np.concatenate([unsqueezed(rows.column(c)[i].as_py()) for i in order]).astype(np.float64)
        customers, tables = known[sweep]
        spare = (ROOT_STRENGTH + ROOT_DISCOUNT * tables) / (n_words + 1)
        return of("a"), (of("b") - ROOT_DISCOUNT * of("c") + spare) / (ROOT_STRENGTH + customers)

    def seats(block: Block, c_pair: np.ndarray):
        """A function of a sweep and the state before it, that draws the tables of the block's pairs; of its context's
        tables one, of the dish itself, doesn't count in the pull."""
        dishes = Dishes(c_pair)
        keys, contexts, seconds = block.pairs(dishes.several), block.contexts[dishes.several], block.seconds[dishes.several]

        def seated(tables: np.ndarray, parent: np.ndarray, sweep: int) -> np.ndarray:
            pull = (STRENGTH + DISCOUNT * np.maximum(tables - 1, 0.0))[contexts] * parent[seconds]
            return dishes.drawn(keys, pull, DISCOUNT, sweep)

        return seated

    def asked(blocks: pa.Table, answers: pa.Table | None, sweep: int) -> pa.Table:
        block, c_word, c_pair = loaded(blocks)
        owner = np.unpackbits(np.frombuffer(block.one("owner"), np.uint8), count=len(c_pair))
        tables = seats(block, c_pair)(*state(c_word, answers, sweep - 1), sweep) * owner
        by_context = np.bincount(block.contexts, tables, minlength=len(block.words)).astype(np.int64)
        by_word = np.bincount(block.seconds, tables, minlength=len(block.words)).astype(np.int64)
        at = cuts(block.words, ranges)
        return messages(block.g, [(r, squeezed_keys(block.words[at[r] : at[r + 1]]), *(squeezed(s[at[r] : at[r + 1]]) for s in (by_context, by_word))) for r in range(ranges) if at[r] < at[r + 1]])

    def answered(t: pa.Table, sweep: int, root_tables: int) -> pa.Table:
        senders, keys, place, _ = merged(t)
        r = t.column("r")[0].as_py()
        in_context, customers = (np.bincount(place, sent(t, c)).astype(np.int64) for c in ("a", "b"))
        pull = (ROOT_STRENGTH + ROOT_DISCOUNT * max(root_tables - 1, 0)) / (n_words + 1)
        tables = drawn_tables(keys, customers, np.full(len(keys), pull), ROOT_DISCOUNT, sweep)
        out = [messages(g, [(r, None, *(squeezed(x[place[some]]) for x in (in_context, customers, tables)))]) for g, some in senders]
        return pa.concat_tables([*out, messages(-1, [(r, None, squeezed(np.array([customers.sum(), tables.sum()])))])])

    by_block = ready.select("g", "words", "contexts", "seconds", "c_word", "c_pair", "owner").groupBy("g")

    def one_sweep(sweep: int, before: DataFrame | None, root_tables: int) -> DataFrame:
        def ask(_key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
            return asked(blocks, answers, sweep)

        def ask_first(blocks: pa.Table) -> pa.Table:
            return asked(blocks, None, sweep)

        def answer(t: pa.Table) -> pa.Table:
            return answered(t, sweep, root_tables)

        sums = by_block.applyInArrow(ask_first, MESSAGE) if before is None else by_block.cogroup(before.where("g >= 0").groupBy("g")).applyInArrow(ask, MESSAGE)
        return spool(sums.groupBy("r").applyInArrow(answer, MESSAGE).withColumn("sweep", F.lit(sweep)))

    swept: list[DataFrame] = []
    root_tables = n_words  # each word has one table at least
    for sweep in range(BURN_IN + SAMPLES):
        swept.append(one_sweep(sweep, swept[-1] if swept else None, root_tables))
        known.append(tuple(totals_of(swept[-1], 2)))
        root_tables = known[-1][1]

    def score(_key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block, c_word, c_pair = loaded(blocks)
        sizes, pair_of = (unsqueezed(block.one(c)).astype(np.int64) for c in ("sizes", "pair_of"))
        customers = STRENGTH + np.maximum(c_word[block.contexts], c_pair)
        seated = seats(block, c_pair)
        p = np.zeros(len(c_pair))
        tables, parent = state(c_word, answers, BURN_IN - 1)
        for sweep in range(BURN_IN, BURN_IN + SAMPLES):
            own = seated(tables, parent, sweep)
            tables, parent = state(c_word, answers, sweep)
            p += (c_pair - DISCOUNT * own + (STRENGTH + DISCOUNT * tables)[block.contexts] * parent[block.seconds]) / customers
        each = np.log10(p / SAMPLES)[pair_of]
        base = np.log10((c_word + 1) / (n_train + n_words + 1))
        ends = np.cumsum(sizes)
        starts = np.r_[0, ends[:-1]]
        sums = [np.add.reduceat(x, starts) for x in ((c_word > 0).astype(np.int64)[block.seconds][pair_of], base[block.seconds][pair_of], each)]
        columns = {
            "id": pa.array(blocks.column("ids")[0].as_py(), pa.int64()),
            "learn": pa.array(blocks.column("learn")[0].as_py(), pa.bool_()),
            "n_tokens": pa.array(sizes, pa.int64()),
            "n_known": pa.array(sums[0], pa.int64()),
            "train_tokens": pa.array(np.full(len(starts), n_train), pa.int64()),
            "base_score": pa.array(sums[1], pa.float64()),
            "score": pa.array(sums[2], pa.float64()),
        }
        if with_tokens:
            columns["token_scores"] = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(each))
        return pa.table(columns)

    answers = swept[max(0, BURN_IN - 1)]
    for s in swept[max(0, BURN_IN - 1) + 1 :]:
        answers = answers.union(s)
    schema = "id bigint, learn boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double" + (", token_scores array<double>" if with_tokens else "")
    return ready.drop("own", "owner").groupBy("g").cogroup(answers.where("g >= 0").groupBy("g")).applyInArrow(score, schema)


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(7)) == 2, F.lit(False))
    scored = score_texts(docs.select(F.col("doc_id").cast("long").alias("id"), (~held_out).alias("learn"), "text"))
    return scored.select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
