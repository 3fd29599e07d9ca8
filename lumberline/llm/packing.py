"""Packing of tokenised documents into sequences of fixed capacity.

Pieces above a third of the capacity are matched first, two to a sequence at most: the largest takes the largest that
still fits beside it. Smaller pieces then go, largest first, into the fullest sequence that holds them. Both steps
depend on lengths alone, and lengths are whole numbers up to the capacity; so they run on the histogram of lengths,
which has at most ``capacity`` rows whatever the input, and give a list of layouts with multiplicities. Each piece finds
its place by its ordinal among the pieces of its length. The result is what the algorithm gives piece by piece.

A mixture of sources is packed stretch by stretch: each stretch of consecutive documents fills sequences of its own, and
the sequences are numbered in the order of the stretches.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ordinal_within, seeded_hash, spool
from .mixing import SEED, mix_sources

CAPACITY = 1024
END_ID = 2
#: Characters of text that a worker encodes at a time (its arrays take some 20 times as much), and of the longest word that
#: it merges itself.
BATCH_CHARS, _LONGEST = 1 << 21, 48
#: Documents of the mixture that are packed together.
STRETCH = 4_096
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

# A space between two words starts a token by the tokenizer's own rule, unless white space stands on both its sides.
_NOT_SPLITTABLE = re.compile(r"(?<=\s) (?:\s|\Z)").search
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(f"[{_LETTERS}0-9!-/:-@\\[-`{{-~ \n]*").fullmatch
# Fixed value: how the tokenizer splits a text of these characters.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+").findall
_NO_RANK = np.iinfo(np.int32).max
_SPECIAL = "<|endoftext|>"


class BytePairs:
    """Byte-level BPE of many short strings at once: each round merges the lowest-ranked pair of every string.

    Made from a tokenizer file whose merges have the ids after the 256 bytes, in order. Strings of one length form a
    matrix; a merge takes one column from each row, so rows of a matrix stay of one length, and a row is done when none
    of its pairs has a rank.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merged = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        keys = merged[:, 0] << 32 | merged[:, 1]
        order = np.argsort(keys)
        self.pairs, self.ranks, self.ids = keys[order], order.astype(np.int32), merged[:, 2].astype(np.int32)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves
        chars = dict.fromkeys(printable)
        other = (chr(256 + i) for i in range(256))
        self.bytes = np.array([vocab[chr(b) if b in chars else next(other)] for b in range(256)], np.int32)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == keys, self.ranks[at], _NO_RANK)

    def encode(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each string's start; one more for the end)."""
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        flat = np.frombuffer(b"".join(strings), np.uint8)
        starts = np.r_[0, np.cumsum(lengths)]
        sizes, found = np.zeros(len(strings), np.int64), []
        order = np.argsort(lengths, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []
        for group in groups:
            n = int(lengths[group[0]])
            for lo in range(0, len(group) if n else 0, 1 << 15):
                members = group[lo : lo + (1 << 15)]
                ids = self.bytes[flat[starts[members][:, None] + np.arange(n)]]
                for rows, out in self._merge(ids):
                    sizes[members[rows]] = out.shape[1]
                    found.append((members[rows], out))
        ends = np.cumsum(sizes)
        result = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for members, out in found:
            result[(ends - sizes)[members][:, None] + np.arange(out.shape[1])] = out
        return result, np.r_[0, ends]

    def _merge(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = np.arange(len(ids))
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            n = ids.shape[1]
            if n == 1:
                yield rows, ids
                return
            best = rank.argmin(axis=1)
            lowest = rank[np.arange(len(rows)), best]
            done = lowest == _NO_RANK
            if done.any():
                yield rows[done], ids[done]
                rows, ids, rank, best, lowest = rows[~done], ids[~done], rank[~done], best[~done], lowest[~done]
            if not len(rows):
                return
            every = np.arange(len(rows))
            ids[every, best] = self.ids[lowest]
            ids = ids[np.arange(n) != best[:, None] + 1].reshape(len(rows), n - 1)
            rank = rank[np.arange(n - 1) != best[:, None]].reshape(len(rows), n - 2)
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self._rank(ids[left, best[left] - 1], ids[left, best[left]])
            right = np.flatnonzero(best < n - 2)
            rank[right, best[right]] = self._rank(ids[right, best[right]], ids[right, best[right] + 1])


class WordEncoder:
    """Token ids of whole texts.

    Byte-level BPE never joins across the space before a word, so a text is the concatenation of its words' ids: each
    distinct word of a batch is encoded once, and not again if the batch before had it. Words of Latin letters, digits and
    ASCII signs are split by the tokenizer's own rule and merged by ``BytePairs``; all others, and texts for which a space
    is no safe cut (white space on both its sides, the special token's string), go through the library as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pairs = BytePairs(path)
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}  # of the last batch's words in ``starts``
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for lo in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 4096], add_special_tokens=False)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each word's start; one more for the end)."""
        parts: dict[str, int] = {}
        number = parts.setdefault
        of_word: list[int] = []
        counts = np.zeros(len(words), np.int64)
        other = []
        for i, word in enumerate(words):
            if len(word) > _LONGEST or not _PLAIN(word):
                other.append(i)
                continue
            split = _PARTS(word)
            counts[i] = len(split)
            of_word += [number(p, len(parts)) for p in split]
        flat, starts = self.pairs.encode([p.encode() for p in parts])
        joined, ends = gathered(flat, starts, np.array(of_word, np.int64))
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        if not other:
            return joined, bounds
        extra = self._library([words[i] for i in other])
        pool = np.concatenate([joined, *extra])
        begin, size = bounds[:-1].copy(), np.diff(bounds)
        size[other] = [len(e) for e in extra]
        begin[other] = len(joined) + np.cumsum([0, *map(len, extra)])[:-1]
        at = np.cumsum(size)
        return pool[np.repeat(begin - (at - size), size) + np.arange(int(at[-1]))], np.r_[0, at]

    def recalled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``words`` for distinct ones, with the ids that the call before found. One call's words are kept, if they have
        up to ``BATCH_CHARS`` ids."""
        place = np.fromiter((self.places.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        place[new] = len(self.places) + np.arange(len(new))
        ids, starts = self.words([words[i] for i in new.tolist()])
        ids, ends = gathered(np.concatenate([self.ids, ids]), np.r_[self.starts[:-1], len(self.ids) + starts], place)
        starts = np.r_[0, ends]
        self._forget()
        if len(ids) <= BATCH_CHARS:
            self.places, self.ids, self.starts = dict(zip(words, range(len(words)))), ids, starts
        return ids, starts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, each followed by the end id; where each text's ids end)."""
        values = [t or "" for t in texts.to_pylist()]
        whole = [i for i, t in enumerate(values) if _NOT_SPLITTABLE(t) or _SPECIAL in t]
        apart = self._library([values[i] for i in whole])
        for i in whole:
            values[i] = ""
        lists = pc.split_pattern(pa.array(values, pa.large_string()), " ")
        del values
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        known = coded.dictionary.to_pylist()
        place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        firsts: dict[str, int] = {}  # the first word of a text has no space before it
        place[bounds[:-1]] = [firsts.setdefault(known[p], len(known) + len(firsts)) for p in place[bounds[:-1]].tolist()]
        ids, starts = self.recalled([" " + w for w in known] + list(firsts))
        pool = np.concatenate([ids, *apart, np.array([END_ID], np.int32)])
        starts = np.r_[starts[:-1], len(ids) + np.cumsum([0, *map(len, apart)]), len(pool)]
        place[bounds[:-1][whole]] = len(known) + len(firsts) + np.arange(len(whole))
        end = len(starts) - 2
        with_ends = np.insert(place, bounds[1:], end)
        flat, ends = gathered(pool, starts, with_ends)
        return flat, ends[bounds[1:] + np.arange(len(texts))]


def gathered(pool: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stretches ``which`` of ``pool`` one after another, where each ends)."""
    sizes = np.diff(starts)[which]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts[which] - (ends - sizes), sizes) + np.arange(total)], ends


_encoders: dict[str, WordEncoder] = {}


def _encoder(name: str) -> WordEncoder:
    if name not in _encoders:
        path = name
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _encoders[name] = WordEncoder(path)
    return _encoders[name]


def tokenized_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each piece of each document: its ids and the end id, cut only where they exceed the capacity.

    A null or empty text is the end id alone. Null ids and repeated rows are kept. ``with_ids`` adds the ids themselves,
    ``keep`` these columns of ``df``.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "") + "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    end = np.array([END_ID], "<u4").tobytes()

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder, texts = _encoder(tokenizer), batch.column(1)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(texts):
            before = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, before + BATCH_CHARS, "right")))
            flat, ends = encoder.encode(texts.slice(lo, hi - lo))
            n = np.diff(ends, prepend=0)
            pieces = -(-n // capacity)
            of_text = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(of_text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = n - (pieces - 1) * capacity  # only the first piece may be shorter
            start = np.where(piece > 0, first[of_text] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[of_text])
            begin = (ends - n)[of_text] + start
            data = memoryview(flat.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(begin.tolist(), length.tolist())]
            taken = pa.array(lo + of_text)
            columns = [batch.column(0).take(taken).cast(pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:  # pieces of a text follow one another, and so do texts
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(flat)))
                names.append("ids")
            columns += [batch.column(2 + k).take(taken) for k in range(len(keep))]
            names += keep
            yield pa.RecordBatch.from_arrays(columns, names)
            lo = hi

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep).mapInArrow(lambda batches: (out for b in batches for out in rows(b)), schema)


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces of each length: (length, first ordinal, end ordinal, first sequence, pieces
    to a sequence, offset). The nth of them goes to sequence ``first + n // pieces`` at ``offset + n % pieces * length``.
    """
    places: list[tuple[int, int, int, int, int, int]] = []
    left = {s: n for s, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # free length -> (first sequence, sequences)
    total = 0

    def put(size: int, n: int, first: int, each: int, offset: int) -> None:
        places.append((size, used[size], used[size] + n, first, each, offset))
        used[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            i = bisect.bisect_right(large, min(capacity - size, size)) - 1
            while i >= 0 and not (left[large[i]] >= (2 if large[i] == size else 1)):
                i -= 1
            if i < 0:
                n = left[size]
                put(size, n, total, 1, 0)
                gaps.setdefault(capacity - size, []).append((total, n))
            else:
                other = large[i]
                n = left[size] // 2 if other == size else min(left[size], left[other])
                put(size, n, total, 1, 0)
                put(other, n, total, 1, size)
                gaps.setdefault(capacity - size - other, []).append((total, n))
            total += n
    open_gaps = sorted(g for g in gaps if g)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            i = bisect.bisect_left(open_gaps, size)
            if i == len(open_gaps):
                each = capacity // size
                fresh = -(-left[size] // each)
                gaps.setdefault(capacity, []).append((total, fresh))
                bisect.insort(open_gaps, capacity) if capacity not in open_gaps else None
                total += fresh
                continue
            gap = open_gaps[i]
            first, n = gaps[gap].pop()
            each = gap // size
            full = min(n, left[size] // each)
            taken = full
            if full:
                put(size, full * each, first, each, capacity - gap)
                _free(gaps, open_gaps, gap - each * size, first, full)
            if full < n and left[size]:  # fewer than `each` are left: one more sequence takes them
                rest = left[size]
                put(size, rest, first + full, rest, capacity - gap)
                _free(gaps, open_gaps, gap - rest * size, first + full, 1)
                taken += 1
            if taken < n:
                gaps[gap].append((first + taken, n - taken))
            elif not gaps[gap]:
                open_gaps.remove(gap)
                del gaps[gap]
    return places


def _free(gaps: dict, open_gaps: list[int], gap: int, first: int, n: int) -> None:
    if gap:
        if gap not in gaps:
            bisect.insort(open_gaps, gap)
        gaps.setdefault(gap, []).append((first, n))


def pack(pieces: DataFrame, capacity: int = CAPACITY, seed: int = 11) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Ties between pieces of one length are broken by a seeded hash of id and piece. An empty table gives an empty result;
    a length out of range raises a ``ValueError``. ``pieces`` is read three times: spool it if it is dear.
    """
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    if any(s is None or not 0 < s <= capacity for s in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    spark = pieces.sparkSession
    places = spark.createDataFrame(pack_counts(histogram, capacity), "size bigint, lo bigint, hi bigint, first bigint, each bigint, at bigint")
    ranked = ordinal_within(pieces.withColumn("__hash", seeded_hash(seed, F.col("doc_id"), F.col("piece"))), "length", "__hash", "__nth")
    joined = ranked.join(F.broadcast(places), (F.col("length") == F.col("size")) & (F.col("__nth") >= F.col("lo")) & (F.col("__nth") < F.col("hi")))
    return (
        joined.withColumn("sequence_id", F.expr("first + (__nth - lo) div each"))
        .withColumn("offset", F.expr("at + (__nth - lo) % each * size"))
        .drop("__hash", "__nth", "size", "lo", "hi", "first", "each", "at")
    )


def pack_stretches(pieces: DataFrame, capacity: int = CAPACITY, seed: int = 11) -> DataFrame:
    """``pieces`` (with ``length`` and ``stretch``) with ``sequence_id`` and ``offset``: each stretch is packed for itself
    as by ``pack``, and its sequences follow those of the stretches before. ``pieces`` is read several times.
    """

    def layouts(pdf: pd.DataFrame) -> pd.DataFrame:
        places = pack_counts(dict(zip(pdf["length"].tolist(), pdf["n"].tolist())), capacity)
        out = pd.DataFrame(places, columns=["size", "lo", "hi", "first", "each", "at"])
        out.insert(0, "part", pdf["stretch"].iloc[0])
        return out

    histograms = pieces.groupBy("stretch", "length").agg(F.count(F.lit(1)).alias("n"))  # <= capacity rows a stretch
    places = spool(histograms.groupBy("stretch").applyInPandas(layouts, "part bigint, size bigint, lo bigint, hi bigint, first bigint, each bigint, at bigint"))
    used = places.groupBy("part").agg(F.max(F.expr("first + (hi - lo + each - 1) div each")).alias("n")).orderBy("part").collect()  # one row a stretch
    base = np.cumsum([0, *[r["n"] for r in used]]).tolist()
    bases = pieces.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(used, base)], "__part bigint, __base bigint")
    placed = places.join(F.broadcast(bases), F.col("part") == F.col("__part")).drop("__part")
    one = Window.partitionBy("stretch", "length").orderBy(seeded_hash(seed, F.col("doc_id"), F.col("piece")))  # a stretch is small
    ranked = pieces.withColumn("__nth", F.row_number().over(one) - 1)
    inside = (F.col("stretch") == F.col("part")) & (F.col("length") == F.col("size")) & (F.col("__nth") >= F.col("lo")) & (F.col("__nth") < F.col("hi"))
    return (
        ranked.join(placed, inside)
        .withColumn("sequence_id", F.expr("__base + first + (__nth - lo) div each"))
        .withColumn("offset", F.expr("at + (__nth - lo) % each * size"))
        .drop("__nth", "part", "size", "lo", "hi", "first", "each", "at", "__base")
    )


def pack_mixture(df: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", stretch: int = STRETCH, source_col: str = "source", **mix) -> DataFrame:
    """All documents, tokenised, cut, and packed in the order of their mixture (``mix``: parameters of ``mix_sources``):
    each ``stretch`` documents that follow one another there fill sequences of their own. One row for each piece.

    The order is that of ``mix_sources`` on ``df``, found again from the sources and hashes alone: no text is shuffled.
    """
    rows = df.select("doc_id", "text", F.col(source_col).cast("string").alias("source"), seeded_hash(mix.get("seed", SEED), F.col("doc_id"), F.col("text")).alias("hash"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    pieces = spool(tokenized_pieces(rows, tokenizer=tokenizer, capacity=capacity, keep=("source", "hash", "row")))
    order = pieces.where("piece = 0").select("source", "hash", F.col("row").alias("__row"))
    mixed = mix_sources(order, hash_col="hash", **mix).select("__row", F.expr(f"mix_position div {stretch}").alias("stretch"))
    return pack_stretches(spool(pieces.join(mixed, F.col("row") == F.col("__row")).drop("source", "hash", "row", "__row")), capacity)


def pack_documents(df: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """All documents, tokenised, cut and packed: one row for each piece."""
    return pack(spool(tokenized_pieces(df, tokenizer=tokenizer, capacity=capacity, with_ids=with_ids)), capacity)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
