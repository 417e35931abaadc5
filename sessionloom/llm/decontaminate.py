"""Operator 2: benchmark decontamination by the CGK embedding and bit-sampling LSH.

Texts and items become sequences of word symbols (lower case, punctuation dropped; in scripts without spaces
each character is a word). An item occurs where its words and a stretch of the text are at most EDITS of the
item's length apart in edit distance on words.

1. Windows of a text, each as long as an item, and the items are embedded by the CGK random walk: at each step
   the current symbol is emitted and a random bit of step and symbol says whether the walk moves on. That
   turns edit distance into Hamming distance.
2. In each of REPEATS repetitions SAMPLED coordinates make a key, and the keys of the windows are looked up
   among those of the items of that length. Equal keys in any repetition make a candidate; there is no other source of candidates.
   At the full number of edits an occurrence is found with probability 0.99 or more.
3. Candidates are verified by the exact edit distance.

Before that, a window is left out if it can hold no item of its length: if fewer of its runs of three words belong to items of that
length than so many edits would leave. That loses nothing and says nothing about which item it may be.

The items are sent to the executors in blocks of at most BLOCK_BYTES; of a benchmark of several blocks one is there at a
time, and the texts with what was found in them are written between two blocks. Whole texts are searched, without a shuffle.

Nulls and empty texts match nothing, nor do null items and those without words. Items of fewer
than six words must occur unchanged; those of one or two are looked up as they are. Of items with equal item_id each is searched. Rows with
equal ids are judged each by its own text. An empty benchmark leaves every document clean. Further columns are passed on; one
named as the result is replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, cut, encoded, factors, hashed, mix, prepare, windows

EDITS, REPEATS, SAMPLED, GRAM = 0.2, 40, 3, 3

BLOCK_BYTES = 16 << 20

#: Candidates that are verified together.
PAIRS = 4096
#: Hits of keys held at once; items of one window from which on their words are counted first; texts searched together.
EXPANDED, MANY, TEXTS = 1 << 20, 8, 64

MATCHES = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:int>>"

_GRAM = [factors(n, 18 + n) for n in range(GRAM + 1)]
_END = U64(0xFFFFFFFFFFFFFFFF)

#: Punctuation beyond ASCII, and characters of scripts that put no spaces between words.
_POINTS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def folded(text: str | None) -> bytes:
    """A text as its words are made from."""
    text = (text or "").lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", _POINTS.sub(" ", text))
    return encoded(text)


def symbols(texts: list[str | None]) -> list[np.ndarray]:
    """The word symbols of each text."""
    out: list[np.ndarray] = []
    for _, counts, h in hashed([folded(t) for t in texts], marks=True):
        out += np.split(h, np.cumsum(counts)[:-1])
    return out


def allowed(n: int, edits: float = EDITS) -> int:
    """Edits that an item of n words may show."""
    return int(edits * n) if n >= 6 else 0


def embed(x: np.ndarray, repeats: int, steps: int) -> np.ndarray:
    """The first `steps` symbols of the CGK embeddings of sequences of equal length, one in each row, by `repeats` walks; one axis of steps first."""
    rows, n = x.shape
    padded = np.concatenate([x, np.full((rows, 1), _END)], axis=1).reshape(-1)
    bits = np.stack([factors(3 * n, 1000 + r) for r in range(repeats)], axis=1)
    base = np.arange(rows)[:, None] * (n + 1)
    place, last, out = np.repeat(base, repeats, axis=1), base + n, np.empty((steps, rows, repeats), np.uint64)
    for step in range(steps):
        symbol = padded[place]
        out[step] = symbol
        place = np.minimum(place + ((symbol ^ bits[step]) * U64(0x9E3779B97F4A7C15) >> U64(63)).astype(np.int64), last)
    return out


def picks(n: int, repeats: int, sampled: int) -> np.ndarray:
    """The coordinates that each repetition samples. A walk takes two steps a symbol on average; later ones only find its end."""
    return np.stack([np.sort(np.random.Generator(np.random.PCG64(2000 + r)).choice(max(sampled, 9 * n // 5), sampled, replace=False)) for r in range(repeats)])


def keys(x: np.ndarray, repeats: int, sampled: int) -> np.ndarray:
    """The keys of sequences of equal length, one column for each repetition; 0 where a sampled walk had come to its end, which all do and which tells nothing."""
    pick = picks(x.shape[1], repeats, sampled)
    out, by = np.zeros((len(x), repeats), np.uint64), factors(sampled + 1, 3000)
    for at in range(0, len(x), 1024):
        walks = embed(x[at : at + 1024], repeats, int(pick.max()) + 1)
        found = walks[pick.T, :, np.arange(repeats)]  # sampled, repeats, rows
        key = mix((found * by[:sampled, None, None]).sum(axis=0, dtype=U64) + np.arange(repeats, dtype=U64)[:, None] * by[sampled])
        out[at : at + 1024] = np.where((found == _END).any(axis=0), U64(0), key | U64(1)).T
    return out


def distances(items: np.ndarray, texts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the least edits between the item and a beginning of the text, and that beginning's length; most + 1 if it takes more than most. Rows of texts are as long as the items and `most` symbols more.

    Only the 2 * most + 1 diagonals are filled that so few edits can reach, and rows that need more are dropped on the way."""
    n, wide = items.shape[1], 2 * most + 1
    edits, ends = np.full(len(items), most + 1), np.zeros(len(items), np.int64)
    texts = np.concatenate([np.full((len(texts), most), _END - U64(1)), texts], axis=1)
    alive, steps = np.arange(len(items)), np.arange(wide, dtype=np.int16)
    row = np.where(steps >= most, steps - most, 1000).astype(np.int16) + np.zeros((len(items), 1), np.int16)
    for i in range(n):
        new = row + (texts[:, i : i + wide] != items[:, i, None])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps  # insertions
        if i % 4 == 3 and not (good := row.min(axis=1) <= most).all():
            row, texts, items, alive = row[good], texts[good], items[good], alive[good]
    if len(alive):
        end = np.argmin(row, axis=1)
        edits[alive], ends[alive] = np.minimum(row[np.arange(len(row)), end], most + 1), n - most + end
    return edits, ends


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, ids: list[int], texts: list[str], edits: float = EDITS, repeats: int = REPEATS, sampled: int = SAMPLED, sift: bool = True):
        self.edits, self.repeats, self.sampled, self.sift = edits, repeats, sampled, sift
        chosen = [(i, s) for i, s in zip(ids, symbols(texts), strict=True) if len(s)]
        self.ids, self.symbols = [i for i, _ in chosen], [s for _, s in chosen]
        by = defaultdict(list)
        for k, s in enumerate(self.symbols):
            by[len(s)].append(k)
        self.short = {n: self._table(np.concatenate([windows(self.symbols[k], np.zeros(1, np.int64), _GRAM[n]) for k in by[n]]), np.array(by[n])) for n in range(1, GRAM) if n in by}
        self.words: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.keyed, grams, sizes = {}, [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for n in sorted(x for x in by if x >= GRAM):
            stack = np.stack([self.symbols[k] for k in by[n]])
            own = self._keys(stack).reshape(-1)
            words, place = np.unique(stack, return_inverse=True)
            self.words[n] = words, place.reshape(stack.shape).astype(np.int32)
            self.keyed[n] = stack, self._table(own[own != 0], np.repeat(np.arange(len(stack)), repeats)[own != 0]), np.array(by[n])
            own = np.unique(np.concatenate([windows(s, np.arange(n - GRAM + 1), _GRAM[GRAM]) for s in stack]))
            grams.append(own)
            sizes.append(np.full(len(own), n))
        self.grams, self.sizes = self._table(np.concatenate(grams), np.concatenate(sizes))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.grams >> U64(42)).astype(np.int64)] = True

    @staticmethod
    def _table(keys_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys_, kind="stable")
        return keys_[order], values[order]

    @staticmethod
    def _look_up(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in wanted, values) of all keys of a table that are wanted."""
        lo, hi = (np.searchsorted(table[0], wanted, side) for side in ("left", "right"))
        count = hi - lo
        entry = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(np.arange(len(wanted)), count), table[1][entry]

    def _keys(self, x: np.ndarray) -> np.ndarray:
        return keys(x, self.repeats, self.sampled)

    def starts(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """For each length of items the places of a text whose windows may hold one."""
        out: dict[int, np.ndarray] = {}
        if len(h) < GRAM or not self.keyed:
            return out
        g = windows(h, np.arange(len(h) - GRAM + 1), _GRAM[GRAM])
        at = np.flatnonzero(self.bits[(g >> U64(42)).astype(np.int64)])
        place, sizes = self._look_up((self.grams, self.sizes), g[at])
        place = at[place]
        for n in self.keyed if not self.sift else np.unique(sizes).tolist():
            e = allowed(n, self.edits)
            need = n - GRAM + 1 - GRAM * e  # runs of three words that so many edits leave
            if not self.sift or need < 1:
                out[n] = np.arange(max(0, len(h) - n + e) + 1)
                continue
            hits = place[sizes == n]
            if len(hits) >= need:
                first = np.unique((hits[:, None] - np.arange(n + e - GRAM + 1)).reshape(-1))
                first = first[first >= 0]
                enough = np.searchsorted(hits, first + n + e - GRAM, "right") - np.searchsorted(hits, first) >= need
                if enough.any():
                    out[n] = first[enough]
        return out

    def _pairs(self, n: int, x: np.ndarray):
        """Window * items + item of the windows and items of n words that share a key, some windows at a time, so that no more than EXPANDED hits (or those of one window) are held.

        Items with a common stem share keys with every window that holds the stem. Where a window has many such items, those are left out that lack in the window more words than edits are allowed: each of these takes an edit, so none is lost."""
        stack, table, _ = self.keyed[n]
        words, place = self.words[n]
        asked = self._keys(x[:, :n])
        lo, hi = (np.searchsorted(table[0], asked, side) for side in ("left", "right"))
        total, at = np.cumsum((hi - lo).sum(axis=1)), 0
        while at < len(x):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + EXPANDED, "right")))
            key, item = self._look_up(table, asked[at:end].reshape(-1))
            w, k = np.divmod(np.unique(key // self.repeats * len(stack) + item), len(stack))
            edges = np.searchsorted(w, np.arange(end - at + 1))
            kept = [np.zeros(0, np.int64)]
            for own in np.flatnonzero(np.diff(edges)):
                some = k[edges[own] : edges[own + 1]]
                if len(some) > MANY:
                    there, found = np.zeros(len(words) + 1, bool), np.searchsorted(words, x[at + own])
                    there[found[words[np.minimum(found, len(words) - 1)] == x[at + own]]] = True
                    some = some[n - there[place[some]].sum(axis=1) <= allowed(n, self.edits)]
                kept.append((at + own) * len(stack) + some)
            yield np.concatenate(kept)
            at = end

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """(item_id, start, end, edits) in words of each text; of matches of one item that overlap, the best."""
        best: dict[tuple[int, int], list] = defaultdict(list)
        every = symbols(texts) if self.ids else []
        wanted = defaultdict(list)
        for t, h in enumerate(every):
            for n, table in self.short.items():
                if len(h) >= n:
                    for p, item in zip(*self._look_up(table, windows(h, np.arange(len(h) - n + 1), _GRAM[n])), strict=True):
                        if np.array_equal(h[p : p + n], self.symbols[item]):
                            best[t, int(item)].append((0, int(p), int(p) + n))
            for n, places in self.starts(h).items():
                wanted[n].append((t, places))
        for n, asked in wanted.items():
            stack, table, items = self.keyed[n]
            e = allowed(n, self.edits)
            t, p = np.concatenate([np.full(len(x), t) for t, x in asked]), np.concatenate([x for _, x in asked])
            padded = {t: np.concatenate([every[t], np.full(n + e, _END)]) for t, _ in asked}
            for begin in range(0, len(t), PAIRS):
                part = slice(begin, begin + PAIRS)
                x = np.stack([padded[a][b : b + n + e] for a, b in zip(t[part].tolist(), p[part].tolist(), strict=True)])
                for pairs in self._pairs(n, x):
                    for at in range(0, len(pairs), PAIRS):
                        w, k = np.divmod(pairs[at : at + PAIRS], len(stack))
                        d, size = distances(stack[k], x[w], e)
                        for good in np.flatnonzero(d <= e):
                            a, b = int(t[begin + w[good]]), int(p[begin + w[good]])
                            best[a, int(items[k[good]])].append((int(d[good]), b, b + int(size[good])))
        out: list[list] = [[] for _ in texts]
        for (t, item), found in best.items():
            taken: list = []
            for d, b, e in sorted(found):
                if all(e <= x or b >= y for _, x, y in taken):
                    taken.append((d, b, e))
            out[t] += [(self.ids[item], b, e, d) for d, b, e in taken]
        return [sorted(x) for x in out]


def find(docs: DataFrame, items: DataFrame, edits: float = EDITS, to: str = "matches", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the benchmark items (item_id, text) that each text holds: item_id, first word, word after the last, edits. A column of that name is replaced."""
    spark = docs.sparkSession
    prepare(spark)
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    docs = docs.drop(to).withColumn(to, F.array().cast(MATCHES))
    kind, schema = T._parse_datatype_string(MATCHES), docs.schema
    for block in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted(map(tuple, part.collect()))  # block_bytes or so
        shared = spark.sparkContext.broadcast(Items([i for i, _ in rows], [t for _, t in rows], edits))

        def run(batches, shared=shared):
            for batch in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
                at = batch.schema.get_field_index(to)
                found = shared.value.search(batch.column(batch.schema.get_field_index("text")).to_pylist())
                old = batch.column(at).to_pylist()
                both = [(o or []) + [dict(zip(("item_id", "start", "end", "edits"), m, strict=True)) for m in f] for o, f in zip(old, found, strict=True)]
                column = pa.array(both, pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])))
                yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

        docs = docs.mapInArrow(run, schema)
        if block + 1 < blocks:  # before the next block is loaded
            docs = cut(docs)
            shared.unpersist()
    assert docs.schema[to].dataType.simpleString() == kind.simpleString()
    return docs


def judged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids, n_matches, least_edits of every row of docs (doc_id, text)."""
    found = find(docs.select("doc_id", F.col("text").cast("string").alias("text")), items)
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_sort(F.array_distinct("matches.item_id")).alias("item_ids"), F.size("matches").cast("long").alias("n_matches"), F.array_min("matches.edits").alias("least_edits"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose texts hold no benchmark item."""
    return find(docs, items).where(F.size("matches") == 0).drop("matches")
