"""Toxicity by a support vector machine on a subsequence string kernel, with Nystroem landmarks.

Strings are words (letters and digits, between end marks; a word with signs inside also in its parts) and words spelled
out letter by letter. The string kernel counts common subsequences of three characters, each weighted by its span to the
power of a decay, so that words with inserted characters or gaps stay close to the word they disguise. A text is the set
of its distinct strings; it is mapped to its kernel values with each landmark, summed and the largest, truncated below
``FLOOR``, and projected by the landmarks' own kernel matrix (Nystroem). The machine is trained on labelled texts in that
space, each with its own label, and on copies of toxic texts whose insults are disguised. Landmarks are strings chosen
from the training texts so that each toxic text holds several.

Characters are coded in 128 codes: a-z, 0-9 and the end marks have one each, all others share the rest by code point
(accented Latin letters fall on different ones).
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_spool, spool

DECAY, SPAN, FLOOR = 0.7, 6, 0.45
LONGEST = 16
#: Bounds of what is learnt from: distinct labelled texts of each label, strings that may be landmarks, landmarks.
TOXIC, CLEAN, CANDIDATES, LANDMARKS = 4_000, 12_000, 4_000, 256
#: A string may be a landmark if so many toxic training texts have it, it is so much likelier in them (log likelihood
#: ratio), and this share of the texts that have it are toxic.
LEAST_TEXTS, LEAST_EVIDENCE, LEAST_SHARE = 3, 6.0, 0.5
#: The threshold lies above all but this share of clean training texts (decided by machines that didn't see them).
CLEAN_LOST = 0.003
#: So many labels at most (some 30 MB) are broadcast; with more, labels and texts meet in a shuffled join.
BROADCAST_LABELS = 1_000_000
#: Texts that score less are clean.
THRESHOLD = 0.3
#: Bytes of text that a worker takes at a time.
BATCH_BYTES = 1 << 23

_CODES = 128
_OTHER = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<!\S)\S(?:[^\S\n]\S(?!\S)){2,}")
_CODE_TABLE = np.array([dict(zip("abcdefghijklmnopqrstuvwxyz0123456789^$", range(1, 39))).get(chr(i)) or 39 + i % 89 for i in range(1 << 16)], np.int32)


def strings_of(token: str) -> list[str]:
    """The strings of one token: its letters and digits, and its parts between signs, between marks; long ones in
    overlapping windows."""
    if token.isalnum():
        found = [token]
    else:
        parts = _OTHER.split(token)
        whole = "".join(parts)
        found = [whole, *(p for p in parts if len(p) < len(whole))]
    out, size = [], LONGEST + 2
    for letters in found:
        if len(letters) > LONGEST:
            marked = f"^{letters}$"
            out += [marked[i : i + size] for i in range(0, len(marked) - size // 2, size // 2)]
        elif len(letters) > 2:
            out.append(f"^{letters}$")
    return out


def tokens_of(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct tokens, the numbers of each text's distinct tokens, where each text's end): whole texts, lower case;
    a run of single characters also counts as one token."""
    values = pa.array([t or "" for t in texts], pa.large_string())
    lists = pc.utf8_split_whitespace(pc.utf8_lower(values))
    bounds = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled: dict[str, int] = {}
    own = []
    for i, text in enumerate(texts):
        found = np.unique(place[bounds[i] : bounds[i + 1]])
        runs = {_OTHER.sub("", m.group()).lower() for m in _SPELLED.finditer(text)} if text else ()
        own.append(np.r_[found, [spelled.setdefault(r, len(known) + len(spelled)) for r in sorted(runs)]].astype(np.int64) if runs else found)
    return known + list(spelled), np.concatenate([*own, np.zeros(0, np.int64)]), np.cumsum([len(x) for x in own])


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
    at = np.array(at, np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] - 2).astype(np.float64)


def subsequences(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions in ``strings``, subsequence codes, the weight of each place), strings of one length at a time."""
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        by_length.setdefault(len(s), []).append(i)
    for n, members in by_length.items():
        at, weight = _triples(n)
        for lo in range(0, len(members) if len(at) else 0, 2048):
            some = np.array(members[lo : lo + 2048])
            points = np.frombuffer("".join([strings[i] for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), n)
            chars = _CODE_TABLE[points & 0xFFFF]
            yield some, (chars[:, at[:, 0]] * _CODES + chars[:, at[:, 1]]) * _CODES + chars[:, at[:, 2]], weight


def norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The length of each row's vector; the weights of a subsequence that occurs more than once are added up."""
    order = np.argsort(codes, axis=1, kind="stable")
    ordered = np.take_along_axis(codes, order, 1)
    first = np.ones(codes.shape, bool)
    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    sums = np.bincount(np.cumsum(first.ravel()) - 1, weight[order].ravel())
    return np.sqrt(np.bincount(np.nonzero(first)[0], sums * sums, minlength=len(codes)))


class Landmarks:
    """The landmarks' vectors by subsequence, so that a string meets only the landmarks that share one with it."""

    def __init__(self, marks: list[str]):
        keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
        for rows, codes, weight in subsequences(marks):
            keys.append((codes.astype(np.int64) * len(marks) + rows[:, None]).ravel())
            weights.append((weight / norms(codes, weight)[:, None]).ravel())
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        self.n = len(marks)
        self.weight = np.bincount(place, np.concatenate(weights), minlength=len(key)).astype(np.float32)
        self.mark = key % max(1, self.n)
        self.start = np.searchsorted(key // max(1, self.n), np.arange(_CODES**3 + 1)).astype(np.int32)

    def near(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, landmark, kernel) of all pairs with a kernel of ``FLOOR`` at least. Kernels are divided by the exact
        length of a string's vector only where its least possible length lets them reach that."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for rows, codes, weight in subsequences(strings):
            first = self.start[codes]
            count = self.start[codes + 1] - first
            i, j = np.nonzero(count)
            first, count = first[i, j], count[i, j]
            ends = np.cumsum(count)
            if not len(ends):
                continue
            at = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
            dots = np.bincount(np.repeat(i * self.n, count) + self.mark[at], self.weight[at] * np.repeat(weight[j].astype(np.float32), count), minlength=len(rows) * self.n).reshape(len(rows), self.n)
            hot = np.flatnonzero(dots.max(axis=1) >= 0.999 * FLOOR * math.sqrt((weight * weight).sum()))
            if len(hot):
                kernel = dots[hot] / norms(codes[hot], weight)[:, None]
                x, y = np.nonzero(kernel >= FLOOR)
                out.append((rows[hot[x]], y, np.minimum(kernel[x, y], 1.0)))
        return tuple(np.concatenate(c) for c in zip(*out))


def kernel_matrix(marks: list[str]) -> np.ndarray:
    """The landmarks' kernels with each other, truncated."""
    out = np.zeros((len(marks), len(marks)))
    x, y, kernel = Landmarks(marks).near(marks)
    out[x, y] = truncated(kernel)
    return (out + out.T) / 2


def truncated(kernel: np.ndarray) -> np.ndarray:
    return (kernel - FLOOR) / (1 - FLOOR)


def squared_hinge_svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.15, rounds: int = 40) -> np.ndarray:
    """A linear machine in the primal (the bias last), by Newton steps on the rows inside the margin."""
    z1 = np.c_[z, np.ones(len(z))]
    w = np.zeros(z1.shape[1])
    penalty = np.eye(len(w)) * ridge
    penalty[-1, -1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(rounds):
        a = z1[active] * weight[active, None]
        w = np.linalg.solve(a.T @ z1[active] + penalty, a.T @ y[active])
        now = y * (z1 @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


@dataclass
class Model:
    """The machine: a coefficient for each landmark's sum and for its largest kernel, one (not above zero: the longer a
    text, the more is near by chance) for the number of strings, a bias, and a sigmoid."""

    marks: list[str]
    coefficients: np.ndarray
    slope: float = 4.0
    offset: float = 0.0
    table: Landmarks | None = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def near_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, landmark, truncated kernel): the nearest of a token's strings counts; ordered by token."""
        if self.table is None:
            self.table = Landmarks(self.marks)
        found = [strings_of(t) for t in tokens]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        string, mark, kernel = self.table.near([s for f in found for s in f])
        token = np.repeat(np.arange(len(tokens)), sizes)[string]
        order = np.lexsort((-kernel, mark, token))
        token, mark, kernel = token[order], mark[order], kernel[order]
        first = np.r_[True, (token[1:] != token[:-1]) | (mark[1:] != mark[:-1])] if len(token) else np.zeros(0, bool)
        return token[first], mark[first], truncated(kernel[first])

    def near_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(text, landmark, truncated kernel) of each text's distinct tokens; the number of tokens of each text; all
        tokens; and which token of which text was near a landmark."""
        tokens, own, ends = tokens_of(texts)
        token, mark, kernel = self.near_tokens(tokens)
        start = np.searchsorted(token, np.arange(len(tokens) + 1))
        n = np.diff(ends, prepend=0) if len(texts) else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(texts)), n)
        hit = start[own + 1] > start[own]
        own, text = own[hit], text[hit]
        size = start[own + 1] - start[own]
        at = np.repeat(start[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(text, size), mark[at], kernel[at], n, tokens, own, text

    def decisions(self, texts: list[str | None]) -> np.ndarray:
        """The machine's value of each text; -1 at most for a text without a string near a landmark."""
        if not self.marks:
            return np.full(len(texts), -1.0)
        text, mark, kernel, n, _, _, _ = self.near_texts(texts)
        return decide(text, mark, kernel, n, self.coefficients, len(self.marks))

    def scores(self, texts: list[str | None]) -> list[float]:
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * d + self.offset)))) for d in self.decisions(texts).tolist()]


def pooled(text: np.ndarray, mark: np.ndarray, kernel: np.ndarray, n: np.ndarray, marks: int) -> np.ndarray:
    """The features of texts: sums over the root of their number of strings, largest kernels, and that root."""
    total, largest = np.zeros((len(n), marks)), np.zeros((len(n), marks))
    np.add.at(total, (text, mark), kernel)
    np.maximum.at(largest, (text, mark), kernel)
    return np.c_[total / np.sqrt(n + 10)[:, None], 0.5 * largest, np.sqrt(n) / 20]


def decide(text: np.ndarray, mark: np.ndarray, kernel: np.ndarray, n: np.ndarray, coefficients: np.ndarray, marks: int) -> np.ndarray:
    rows, place = np.unique(text, return_inverse=True)  # the other texts have nothing but their length
    out = np.full(len(n), min(-1.0, coefficients[-1]))
    out[rows] = pooled(place, mark, kernel, n[rows], marks) @ coefficients[:-1] + coefficients[-1]
    return out


def batches_of(column: pa.Array) -> Iterator[list[str | None]]:
    """The values of a column, some megabytes at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + BATCH_BYTES, "right")))
        yield column.slice(lo, hi - lo).to_pylist()
        lo = hi


def training_texts(labelled: DataFrame, toxic: int, clean: int, seed: int) -> DataFrame:
    """(h, text, label): about ``toxic`` and ``clean`` distinct texts, those with the smallest seeded hashes.

    Copies are one text, toxic if any of them is. Only hashes are ranked; a text's copies meet by partial aggregation.
    """
    rows = labelled.where("label is not null").select(F.xxhash64(F.lit(seed), F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"), "label")
    labels = spool(rows.groupBy("h").agg(F.max("label").alias("label")))
    cut = F.lit(False)
    for label, bound in ((1, toxic), (0, clean)):
        last = labels.where(F.col("label") == label).select("h").orderBy("h").limit(bound).agg(F.max("h")).first()[0]
        if last is not None:
            cut = cut | ((F.col("label") == label) & (F.col("h") <= last))
    chosen = labels.where(cut).select(F.col("h").alias("__h"), F.col("label").alias("__label"))  # bounded
    out = rows.join(F.broadcast(chosen), F.col("h") == F.col("__h")).groupBy("h").agg(F.first("text").alias("text"), F.first("__label").alias("label"))
    out = spool(out)
    drop_spool(labels)
    return out


def choose_landmarks(texts_of: list[list[int]], loss: list[float], bound: int, need: float = 0.6) -> list[int]:
    """Candidates, greedily: each adds most to toxic texts that have few of those chosen before (a text's worth falls by
    the factor ``need`` with each) less its loss; until none adds 1, or ``bound`` are chosen."""
    held = np.zeros(1 + max((t for ts in texts_of for t in ts), default=0))
    members = [np.array(ts, np.int64) for ts in texts_of]

    def gain(c: int) -> float:
        return float((need ** held[members[c]]).sum()) - loss[c]

    heap = [(-gain(c), c) for c in range(len(members))]
    heapq.heapify(heap)
    chosen: list[int] = []
    while heap and len(chosen) < bound:
        _, c = heapq.heappop(heap)
        now = gain(c)
        if heap and now < -heap[0][0]:
            heapq.heappush(heap, (-now, c))
            continue
        if now < 1:
            break
        chosen.append(c)
        held[members[c]] += 1
    return chosen


def disguised(word: str, salt: int) -> str:
    """The word with one character put in at an inner place: a letter, a digit, or a doubled one."""
    h = zlib.crc32(f"{salt} {word}".encode())
    i = 1 + h % max(1, len(word) - 1)
    return word[:i] + ("xzqjkvw"[h // 64 % 7], str(h // 64 % 10), word[i - 1], "*")[h // 8 % 4] + word[i:]


def fit(labelled: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, candidates: int = CANDIDATES, landmarks: int = LANDMARKS, seed: int = 5) -> Model:
    """A model from ``labelled`` (text, label 0/1).

    It learns from about ``toxic`` and ``clean`` distinct labelled texts, whole ones, so training costs the same at every
    size. Strings are counted and texts mapped in Spark; to the driver come ``candidates`` strings with the toxic texts that
    have them, then each training text's strings near a landmark. Without texts of both labels, or without a string that
    goes with the label, the model calls everything clean.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, lo = b.column("label").to_numpy(zero_copy_only=False), 0
            for texts in batches_of(b.column("text")):
                tokens, own, ends = tokens_of(texts)
                found = [strings_of(t) for t in tokens]
                n = np.diff(ends, prepend=0)
                counts = {}
                for t, y in zip(own.tolist(), np.repeat(label[lo : lo + len(texts)], n).tolist()):
                    at = counts.setdefault(t, [0, 0])
                    at[y > 0] += 1
                lo += len(texts)
                strings = [(s, c) for t, c in counts.items() for s in found[t]]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in strings], pa.string()), *(pa.array([c[k] for _, c in strings], pa.int64()) for k in (1, 0))], ["word", "t", "c"])

    nothing = Model([], np.zeros(1), 1.0, -10.0)
    sample = training_texts(labelled, toxic, clean, seed)
    sums = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    n, n_toxic = sums[0], int(sums[1] or 0)
    if not 0 < n_toxic < n:
        return nothing
    rate = n_toxic / n
    counted = sample.select("label", "text").mapInArrow(words, "word string, t bigint, c bigint").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    share = "(t / (t + c))"
    evidence = f"t * ln({share} / {rate}) + if(c > 0, c * ln((1 - {share}) / {1 - rate}), 0)"
    telling = counted.where(f"t >= {LEAST_TEXTS} and {share} >= {max(LEAST_SHARE, rate)} and {evidence} > {LEAST_EVIDENCE}")
    telling = telling.orderBy(F.expr(evidence).desc(), "word").limit(candidates).collect()
    if not telling:
        return nothing
    numbers = {r["word"]: i for i, r in enumerate(telling)}

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = []
            for texts in batches_of(b.column(0)):
                tokens, own, ends = tokens_of(texts)
                of_token = [[numbers[s] for s in strings_of(t) if s in numbers] for t in tokens]
                held += [sorted({x for t in part.tolist() for x in of_token[t]}) for part in np.split(own, ends[:-1])] if texts else []
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32()))], ["held"])

    texts_of: list[list[int]] = [[] for _ in telling]
    for i, r in enumerate(sample.where("label = 1").select("text").mapInArrow(holders, "held array<int>").collect()):
        for c in r["held"]:
            texts_of[c].append(i)
    marks = [telling[c]["word"] for c in choose_landmarks(texts_of, [float(r["c"]) for r in telling], landmarks)]
    if not marks:
        return nothing
    model = Model(marks, np.zeros(2 * len(marks) + 2))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, near = [], []
            for texts in batches_of(b.column("text")):
                _, _, _, n, tokens, own, text = model.near_texts(texts)
                sizes += n.tolist()
                near += [[tokens[t] for t in part.tolist()] for part in np.split(own, np.searchsorted(text, np.arange(1, len(texts))))]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("label"), pa.array(sizes, pa.int64()), pa.array(near, pa.list_(pa.string()))], ["h", "label", "n", "near"])

    rows = sorted(sample.select("h", "label", "text").mapInArrow(mapped, "h bigint, label bigint, n bigint, near array<string>").collect())
    drop_spool(sample)
    train(model, np.array([r["label"] for r in rows]) > 0, np.array([r["n"] for r in rows]), [r["near"] for r in rows])
    return model


def train(model: Model, toxic: np.ndarray, n: np.ndarray, near: list[list[str]]) -> None:
    """Coefficients and sigmoid from texts: their labels, their numbers of strings and their strings near a landmark.

    The threshold comes from decisions of two machines, each trained on the other half of the texts.
    """
    m = len(model.marks)
    fake = np.flatnonzero(toxic & np.array([len(x) > 0 for x in near], bool))
    near = near + [[disguised(w, int(i)) for w in near[i]] for i in fake]
    tokens = sorted({w for ws in near for w in ws})
    number = {w: i for i, w in enumerate(tokens)}
    token, mark, kernel = model.near_tokens(tokens)
    start = np.searchsorted(token, np.arange(len(tokens) + 1))
    own = np.array([number[w] for ws in near for w in ws], np.int64)
    size = start[own + 1] - start[own]
    at = np.repeat(start[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    text = np.repeat(np.repeat(np.arange(len(near)), [len(ws) for ws in near]), size)
    values, vectors = np.linalg.eigh(kernel_matrix(model.marks))
    keep = values > 1e-2 * values.max()
    half = vectors[:, keep] / np.sqrt(values[keep])  # kernels @ half = Nystroem features
    root = np.zeros((2 * m + 1, 2 * half.shape[1] + 1))
    root[:m, : half.shape[1]], root[m:-1, half.shape[1] : -1], root[-1, -1] = half, half, 1.0
    all_n = np.r_[n, n[fake]].astype(np.float64)
    z = pooled(text, mark[at], kernel[at], all_n, m) @ root
    y = np.where(np.r_[toxic, np.ones(len(fake), bool)], 1.0, -1.0)
    weight = np.where(y > 0, max(1.0, (~toxic).sum() / toxic.sum() / 3), 1.0)
    weight[len(n) :] *= 0.3
    w = squared_hinge_svm(z, y, weight)
    if w[-2] > 0:
        z[:, -1] = 0
        w = squared_hinge_svm(z, y, weight)
    model.coefficients = np.r_[root @ w[:-1], w[-1]]
    side = np.r_[np.arange(len(n)), fake] % 2  # texts come in the order of their hashes
    unseen = np.zeros(len(n))
    for s in (0, 1):
        other = squared_hinge_svm(z[side != s], y[side != s], weight[side != s])
        held = np.flatnonzero(side[: len(n)] == s)
        unseen[held] = np.c_[z[held], np.ones(len(held))] @ other
    unseen = np.where(np.isin(np.arange(len(n)), text), unseen, np.minimum(unseen, -1.0))
    model.slope, model.offset = sigmoid_fit(unseen, toxic.astype(np.float64))
    least = float(np.quantile(unseen[~toxic], 1 - CLEAN_LOST))
    least += 0.25 * max(0.0, float(np.quantile(unseen[toxic], 0.05)) - least)
    model.offset = math.log(THRESHOLD / (1 - THRESHOLD)) - model.slope * least


def sigmoid_fit(d: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve, lightly damped, so that separable data stay finite."""
    x, w = np.c_[d, np.ones(len(d))], np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + 0.05 * (w @ w))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (p - y) + 0.1 * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 0.1), float(w[1])


def with_scores(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the toxicity of each row's whole text, from 0 to 1. Null and empty texts get the score of no strings.

    All columns go through, whatever their names; one named like ``out`` is replaced. The model is broadcast (some kB).
    A text of any length is held whole by a task; empty tables give empty results.
    """
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(model)
    names, at = df.columns, df.columns.index(text_col)
    safe = df.toDF(*[f"c{i}" for i in range(len(names))])  # passing through Arrow doesn't take every name
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in safe.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [s for texts in batches_of(b.column(at)) for s in shared.value.scores(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "score"])

    return safe.mapInArrow(run, f"{fields}, score double").toDF(*names, out)


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label) of the labelled rows that may be learnt from: those whose crc32(doc_id as text) mod 4 is not 2."""
    by_id = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("toxic").cast("long")).alias("label"))
    if by_id.count() <= BROADCAST_LABELS:
        by_id = F.broadcast(by_id)
    return docs.where(~held_out()).select("doc_id", "text").join(by_id, F.col("doc_id") == F.col("__id")).select("text", "label")


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(learning_rows(docs, labels))
    scored = with_scores(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
