"""Operator 10: byte-pair encoding and decoding.

Encoding is exact and takes linear time: an Aho-Corasick automaton reports every token that occurs
in a piece, the longest one at each place is tried first, and a token may follow another only if the
pair is compatible, that is if merging the two tokens' bytes would give just these two tokens. Where
no token fits, the last one is taken back and shortened; a place found dead is never tried again.
Decoding gathers bytes through an offset table.

A piece of up to LONG bytes is looked up at once. Of a longer one, such as letters without a break, matches are found window by
window and forgotten behind the place that the encoder has come to (and found again if it has to go back), so that it takes
some ten bytes of memory for each of its own.

Nulls count as the empty text; an empty text has no tokens. Texts of any length are encoded whole.
Rows with equal ids are encoded each on its own; further columns are passed on unchanged.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

#: Pieces that a worker remembers; the memory is emptied when full.
REMEMBERED = 500_000

#: Bytes of a piece that are looked up at once.
LONG = 1 << 14

PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"

# Letters and numbers that Unicode got after version 16, ranges of code points. The
# tokenizer's own splitter follows version 16 and takes them for other characters.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 "
    "18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)


def _of(kind: str) -> str:
    """The characters below U+0100 of a kind, as the inside of a class."""
    return "".join(re.escape(chr(c)) for c in range(256) if regex.match(kind, chr(c)))


_newer = "[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split()) + "]"
_latin = re.compile(PIECES.replace(r"[^\s{l}{n}]", f"[^{_of(chr(92) + 's')}{{l}}{{n}}]").replace(r"\s", f"[{_of(chr(92) + 's')}]").replace(r"\S", f"[^{_of(chr(92) + 's')}]").format(L=f"[{_of(chr(92) + 'p{L}')}]", N=f"[{_of(chr(92) + 'p{N}')}]", l=_of(r"\p{L}"), n=_of(r"\p{N}")))
_any = regex.compile(PIECES.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{l}", r"\p{L}").replace("{n}", r"\p{N}"))
_rest = regex.compile(PIECES.replace("{L}", rf"[\p{{L}}--{_newer}]").replace("{N}", rf"[\p{{N}}--{_newer}]").replace(r"[^\s{l}{n}]", rf"[^\s[\p{{L}}--{_newer}][\p{{N}}--{_newer}]]"), regex.V1)
_has_newer = regex.compile(_newer)


def pieces(text: str) -> list[str]:
    """The pieces that are encoded each on its own."""
    try:
        text.encode("latin-1")
        return _latin.findall(text)
    except UnicodeEncodeError:
        return (_rest if _has_newer.search(text) else _any).findall(text)


class Vocabulary:
    """Tables of a byte-level vocabulary whose ids rise with the rank of the merge; read on the driver, sent to the executors (its size is that of the vocabulary file)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.special = {x["content"]: x["id"] for x in model["added_tokens"] if x["special"]}
        ids = model["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = token.encode() if token in self.special else bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.merged: dict[tuple[int, int], int] = {}
        self.halves = [(i, i) for i in range(len(self.bytes_of))]
        for pair in model["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            i = ids[left + right]
            self.merged[ids[left], ids[right]] = i
            self.halves[i] = (ids[left], ids[right])


class Encoder:
    """Encodes pieces and texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, array] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        specials = set(vocabulary.special.values())
        for i, b in enumerate(vocabulary.bytes_of):
            if b and i not in specials and self.whole(i):
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.longest = max(map(len, vocabulary.bytes_of))
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        blob = b"".join(vocabulary.bytes_of)
        self.blob = np.frombuffer(blob, np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in vocabulary.bytes_of])]).astype(np.int64)

    def whole(self, i: int) -> bool:
        """Whether merging a token's own bytes gives that token: if its halves are whole and compatible up to its own merge."""
        left, right = self.v.halves[i]
        return left == i or self.fits(left, right, i)

    def fits(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether b can stand after a: no merge across the border comes before the merges that made the tokens beside it. Both sides are undone, the latest merge first."""
        merged, halves = self.v.merged, self.v.halves
        bound = len(halves) if below is None else below
        while True:
            m = merged.get((a, b))
            if m is not None and m < bound:
                return False
            undo_left, undo_right = halves[a][0] != a or halves[a][1] != a, halves[b][0] != b or halves[b][1] != b
            if undo_left and (a > b or not undo_right):
                bound = min(bound, a)
                a = halves[a][1]
            elif undo_right:
                bound = min(bound, b + 1)  # at equal rank the pair further left is merged first
                b = halves[b][0]
            else:
                return True

    def matches(self, s: str, begin: int = 0, end: int | None = None) -> list[list[tuple[int, int]]]:
        """(size, token) of the tokens that start at each place of s from begin to end, the longest last."""
        end = len(s) if end is None else end
        at: list[list[tuple[int, int]]] = [[] for _ in range(end - begin)]
        for last, (size, i) in self.automaton.iter(s, begin, min(len(s), end + self.longest)):  # ends rise, so the longest comes last
            if last - size + 1 < end:
                at[last - size + 1 - begin].append((size, i))
        return at

    def piece(self, piece: str, window: int = LONG) -> array:
        """Token ids of one piece."""
        s = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(s)
        windows: dict[int, list] = {}

        def seek(place: int) -> list[tuple[int, int]]:
            found = windows.get(place // window)
            if found is None:
                if len(windows) == 2:
                    del windows[min(windows)]
                begin = place // window * window
                found = windows[place // window] = self.matches(s, begin, min(n, begin + window))
            return found[place % window]

        at = seek if n > window else self.matches(s).__getitem__
        places, tokens, rest = array("q"), array("i"), array("i")  # rest: how many tokens of a place are left to try
        dead = bytearray(n + 1)
        compatible, place, left = self.compatible, 0, len(at(0)) if n else 0
        while place < n:
            here, last = at(place), tokens[-1] if tokens else -1
            while left:
                left -= 1
                size, i = here[left]
                if dead[place + size]:
                    continue
                if last >= 0:
                    ok = compatible.get((last, i))
                    if ok is None:
                        if len(compatible) > 2_000_000:
                            compatible.clear()
                        ok = compatible[last, i] = self.fits(last, i)
                    if not ok:
                        continue
                places.append(place)
                tokens.append(i)
                rest.append(left)
                place += size
                left = len(at(place)) if place < n else 0
                break
            else:
                dead[place] = 1
                place, left = places.pop(), rest.pop()
                tokens.pop()
        return tokens

    def encode(self, text: str) -> array:
        """Token ids of a text; the vocabulary's special tokens are recognised."""
        out = array("i")
        known, special = self.known, self.v.special
        parts = self.split_special.split(text) if self.split_special and any(x in text for x in special) else (text,)
        for part in parts:
            if part in special:
                out.append(special[part])
                continue
            for p in pieces(part):
                ids = known.get(p)
                if ids is None:
                    ids = self.piece(p)
                    if len(p) < 64:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[p] = ids
                out += ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids, gathered through the offset table."""
        begin = self.offsets[ids]
        size = self.offsets[ids + 1] - begin
        return self.blob[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))].tobytes()


_encoders: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(shared.value)
    return _encoders[shared.id]


class _Shared:
    """A broadcast with an id that survives pickling."""

    def __init__(self, spark, value):
        self.box = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.box.value


def _append(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """docs with a column of token ids, array<int>; a column of that name is replaced."""
    prepare(docs.sparkSession)
    shared, docs = _Shared(docs.sparkSession, Vocabulary(path)), docs.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared)
        for batch in batches:
            ids = [np.array(coder.encode(x.as_py() or ""), np.int32) for x in batch.column(batch.schema.get_field_index(text))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield _append(batch, to, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """docs with the text that the ids stand for; bytes that are no UTF-8 become U+FFFD. Null ids give the empty text."""
    prepare(docs.sparkSession)
    shared, docs = _Shared(docs.sparkSession, Vocabulary(path)), docs.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [coder.decode(np.asarray(x.values)).decode("utf-8", "replace") if x.is_valid and len(x.values) else "" for x in column]
            yield _append(batch, to, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text)."""
    both = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
