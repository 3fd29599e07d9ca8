"""Byte-pair encoding of whole texts by a dynamic program over prefixes, and decoding.

A sequence of tokens is what byte-pair merging gives exactly if each token merges into itself and each pair of neighbours is
compatible: no merge across their border comes before the merges that use up its two sides. So a prefix of a word has one
possible last token: the one that is a suffix of the prefix (an automaton of all tokens gives these) and is compatible with
the last token of what stands before it. One pass stores that token for each prefix; following the tokens back from the
whole word gives its ids. Time grows with a word's length, not with its square.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

TOKENIZER = "word_bpe_49k.json"
NEVER = 1 << 62
#: Entries of a worker's tables (of pairs and pieces, and of stretches), which start anew beyond it;
#: longer words are not kept.
REMEMBERED, STRETCHES, LONG_WORD = 1 << 18, 1 << 17, 64
#: Bytes of results that a worker sends back together.
SENT_BYTES = 1 << 22
#: Distance of the code points that stand for a word's last byte.
FINAL = 0x1000
#: Stretches of which the normaliser only lowers the letters (no white space beyond ASCII, nothing to compose) ...
LATIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]*").fullmatch
#: ... and, a fixed value, how the tokenizer splits them then.
LATIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+").findall


class PairMerges:
    """The merges of a tokenizer's file, with the tests that the dynamic program needs.

    A merge must come after the merges that make its two sides, and make a token of its own; files of which this doesn't hold
    raise a ``ValueError``, as the order of merges would not decide alone then.
    """

    def __init__(self, vocab: dict[str, int], merges: list[list[str] | str], suffix: str):
        import ahocorasick

        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        made = {a + b for a, b in pairs}
        self.text: dict[int, str] = {}  # of each token its units; the last one of a word is shifted by FINAL
        for name, i in vocab.items():
            if name in made:
                continue
            if len(name) == 1:
                self.text[i] = name
            elif len(name) == 1 + len(suffix) and name.endswith(suffix):
                self.text[i] = chr(ord(name[0]) + FINAL)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        for rank, (a, b) in enumerate(pairs):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if left not in self.text or right not in self.text or whole in self.text:
                raise ValueError(f"merge {rank} doesn't follow its sides, or makes a token twice")
            self.rank[left, right], self.parts[whole], self.text[whole] = rank, (rank, left, right), self.text[left] + self.text[right]
        self._ends: dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]]]] = {}
        self._sound: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self.tokens = ahocorasick.Automaton()
        for i, t in self.text.items():
            if self.sound(i):
                self.tokens.add_word(t, (i, len(t)))
        self.tokens.make_automaton()

    def _edges(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(what stands at the token's left end while it is merged, and when that is used up; the same at its right end)."""
        if (known := self._ends.get(token)) is None:
            known = ([], [])
            for side, edge in ((1, known[0]), (2, known[1])):
                at, used = token, NEVER
                edge.append((at, used))
                while at in self.parts:
                    used, at = self.parts[at][0], self.parts[at][side]
                    edge.append((at, used))
            self._ends[token] = known
        return known

    def _crossed(self, left: int, right: int, before: int) -> bool:
        """Whether a merge across the border of two tokens comes first: of equal merges the left one does."""
        for a, used_a in self._edges(left)[1]:
            for b, used_b in self._edges(right)[0]:
                rank = self.rank.get((a, b), NEVER)
                if rank < before and rank < used_a and rank <= used_b:
                    return True
        return False

    def sound(self, token: int) -> bool:
        """Whether the token's own text merges into it."""
        stack = [token]
        while stack:
            at = stack[-1]
            if at in self._sound:
                stack.pop()
                continue
            if at not in self.parts:
                self._sound[at] = True
                continue
            rank, left, right = self.parts[at]
            todo = [x for x in (left, right) if x not in self._sound]
            if todo:
                stack += todo
                continue
            self._sound[at] = self._sound[left] and self._sound[right] and not self._crossed(left, right, rank)
        return self._sound[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' texts together gives these two."""
        if len(self._pairs) >= REMEMBERED:
            self._pairs.clear()
        known = self._pairs[left << 32 | right] = not self._crossed(left, right, NEVER)
        return known

    def encode(self, word: str) -> list[int]:
        """The ids of a word, given as the tokenizer's characters for its bytes."""
        if not word:
            return []
        units = word[:-1] + chr(ord(word[-1]) + FINAL)
        last = [-1] * len(units)  # of the prefix that ends here
        size = [0] * len(units)
        known = self._pairs.get
        for end, (token, n) in self.tokens.iter(units):
            if last[end] >= 0:
                continue
            if n <= end:
                before = last[end - n]
                if before < 0:
                    continue
                fits = known(before << 32 | token)
                if not (self.compatible(before, token) if fits is None else fits):
                    continue
            last[end], size[end] = token, n
        out, at = [], len(units) - 1
        while at >= 0:
            if last[at] < 0:
                raise ValueError("the vocabulary lacks a byte of the word")
            out.append(last[at])
            at -= size[at]
        return out[::-1]


class TextEncoder:
    """Ids of whole texts. White space ends words in this tokenizer, so a text's ids are those of its
    stretches between ASCII white space, one after another; each distinct stretch is encoded once while it is remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.rules = Tokenizer.from_file(path)  # for its normaliser and its splitting of other than ASCII words
        self.merges = PairMerges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile(f"({'|'.join(map(re.escape, self.special))})") if self.special else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves
        others = (b for b in range(256) if b not in set(printable))
        self.chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.known: dict[bytes, bytes] = {}
        self.merged: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        """The pieces of a stretch that are merged on their own, in the tokenizer's characters for bytes."""
        if LATIN(text):
            return [p if p.isascii() else p.encode().decode("latin-1").translate(self.chars) for p in LATIN_PIECES(text.lower())]
        return [p for p, _ in self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text))]

    def _piece(self, piece: str) -> bytes:
        found = self.merged.get(piece)
        if found is None:
            found = array("I", self.merges.encode(piece)).tobytes()
            if len(piece) <= LONG_WORD:
                if len(self.merged) >= REMEMBERED:
                    self.merged.clear()
                self.merged[piece] = found
        return found

    def stretch(self, raw: bytes) -> bytes:
        """The packed ids of a stretch without ASCII white space."""
        found = self.known.get(raw)
        if found is None:
            text = raw.decode("utf-8", "replace")
            if self._special and self._special.search(text):
                parts = [[array("I", [self.special[p]]).tobytes()] if p in self.special else map(self._piece, self._pieces(p)) for p in self._special.split(text)]
                found = b"".join(chain.from_iterable(parts))
            else:
                found = b"".join(map(self._piece, self._pieces(text)))
            if len(raw) <= LONG_WORD:
                if len(self.known) >= STRETCHES:
                    self.known.clear()
                self.known[raw] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as unsigned 32-bit little-endian numbers; null counts as empty."""
        return b"".join(map(self.stretch, (text or "").encode("utf-8", "replace").split()))


class IdDecoder:
    """Texts of packed ids. The tokenizer has no decoder, so that is its tokens' names between spaces; ids that it doesn't have
    are left out, and null counts as no ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}

    def decode(self, ids: bytes | None) -> str:
        numbers = memoryview(ids or b"").cast("I").tolist()
        try:
            return " ".join(map(self.names.__getitem__, numbers))
        except KeyError:
            return " ".join([self.names[i] for i in numbers if i in self.names])


_loaded: dict[tuple[type, str], TextEncoder | IdDecoder] = {}


def loaded(kind: type, name: str):
    """The encoder or decoder of a tokenizer's file, or of a public one's name; one for each worker."""
    if (kind, name) not in _loaded:
        path = name
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _loaded[kind, name] = kind(path)
    return _loaded[kind, name]


def _mapped(df: DataFrame, column: str, keep: list[str], outs: list[tuple[str, str, pa.DataType]], one: Callable) -> DataFrame:
    """The columns ``keep`` and ``outs`` (name, Spark's type, Arrow's type): ``one`` gives a function from a value to theirs."""
    names = [o for o, _, _ in outs]
    if taken := [o for i, o in enumerate(names) if o in keep or o in names[:i]]:
        raise ValueError(f"a column is already named {taken[0]}")
    quoted, plain = ["`" + k.replace("`", "``") + "`" for k in keep], [f"k{i}" for i in range(len(keep))]  # any name goes through Arrow
    fields = [f"{p} {df.schema[k].dataType.simpleString()}" for p, k in zip(plain, keep)]
    made = [f"done{i}" for i in range(len(outs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = one()
        for b in batches:
            done, size, start = [], 0, 0
            for i, x in enumerate(b.column(len(plain)), 1):
                done.append(f(x.as_py()))
                size += sum(map(len, done[-1]))
                if size >= SENT_BYTES or i == b.num_rows:
                    columns = [pa.array(v, t) for v, (_, _, t) in zip(zip(*done), outs)]
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, i - start) for c in b.columns[: len(plain)]), *columns], [*plain, *made])
                    done, size, start = [], 0, i

    rows = df.select(*[F.col(q).alias(p) for q, p in zip(quoted, plain)], F.col(column).alias("given"))
    return rows.mapInArrow(run, ", ".join([*fields, *(f"{m} {kind}" for m, (_, kind, _) in zip(made, outs))])).toDF(*keep, *names)


def encode_texts(df: DataFrame, keep: list[str], text_col: str = "text", out: str = "ids", tokenizer: str = TOKENIZER, decoded: str | None = None) -> DataFrame:
    """The columns ``keep`` of each row and ``out``: its whole text's ids, packed as unsigned 32-bit little-endian numbers.
    With ``decoded`` also a column of that name, as ``decode_ids`` gives it: by the same worker, where a second pass over the
    ids would have workers of its own beside it.

    Null and empty texts have no ids. Rows are encoded where they stand, without a shuffle; repeated rows and null keys are
    kept, an empty table gives an empty one. A text of any length is one row of a task, which holds it and its ids. Strings of
    the special tokens give these tokens. Lone surrogates count as question marks. A column of ``keep`` named like ``out`` or
    ``decoded`` raises a ``ValueError``.
    """

    def coder() -> Callable[[str | None], tuple]:
        encode = loaded(TextEncoder, tokenizer).encode
        if decoded is None:
            return lambda text: (encode(text),)
        decode = loaded(IdDecoder, tokenizer).decode

        def both(text: str | None) -> tuple[bytes, str]:
            ids = encode(text)
            return ids, decode(ids)

        return both

    return _mapped(df, text_col, keep, [(out, "binary", pa.binary())] + ([(decoded, "string", pa.string())] if decoded is not None else []), coder)


def decode_ids(df: DataFrame, keep: list[str], ids_col: str = "ids", out: str = "decoded", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` of each row and ``out``: the text of its packed ids; no ids give the empty text, as does null."""

    def decoder() -> Callable[[bytes | None], tuple]:
        decode = loaded(IdDecoder, tokenizer).decode
        return lambda ids: (decode(ids),)

    return _mapped(df, ids_col, keep, [(out, "string", pa.string())], decoder)


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    done = encode_texts(read(spark, sf_dir, "documents"), ["doc_id"], decoded="decoded")
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
