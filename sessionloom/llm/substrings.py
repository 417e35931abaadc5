"""Operator 7: removal of passages that occur in an earlier document, by difference-cover anchors.

A window is WINDOW consecutive words. Anchors are ANCHOR words that start at a place of which the
remainder modulo PERIOD is in COVER. COVER is a difference cover: for any two places there is a
shift below PERIOD that takes both to cover places. As PERIOD + ANCHOR - 1 = WINDOW, two equal
windows always share an anchor at the same shift, so only anchors, three places in seven, are
compared across documents. Windows are hashed (96 bits) only where they hold an anchor that some
other document has as well, and the least doc_id of each is found.

Documents are dealt into chunks by a hash. What leaves a chunk are packed arrays of distinct hashes,
one for each bucket of hash values: anchors first, then windows, each once with the least doc_id that has it in the
chunk. What comes back are the windows that repeat, each once with the least doc_id of all; the chunk itself finds
where they stand. So a passage that a third of the documents hold is one entry for each chunk, anchors and windows
alike, whatever the number of copies. The numbers of chunks and buckets follow the input. Every text is shuffled once; the three steps
that read it share that shuffle.

Words are runs without 0x20 and 0x09 to 0x0D. A null or empty text has no words. A null doc_id counts
as larger than every number. Rows with the same doc_id do not remove from each other; rows of equal
id and text get equal results: where ids repeat, such rows are counted, treated once and given out as often as they came.
An empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ordered_numbers
from .common import U64, encoded, factors, few_files, groups_for, hashed, prepare, text_bytes, windows

WINDOW, ANCHOR, PERIOD, COVER = 13, 7, 7, (0, 1, 3)

#: Bytes of text in a chunk, and of anchors in a bucket.
CHUNK, BUCKET = 4 << 20, 8 << 20

#: Copies of a row that one task gives out at a time.
COPIES = 10_000

_LAST = 2**63 - 1
_ANCHOR, _WINDOW, _SECOND = factors(ANCHOR, 71), factors(WINDOW, 72), factors(WINDOW, 73)


def _docs(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a chunk."""
    return np.array([_LAST if x is None else x for x in table["doc_id"].to_pylist()], np.int64), list(map(encoded, table["text"].to_pylist()))


def _anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cover places of a document and the hashes of their anchors."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.arange(len(h) - ANCHOR + 1)
    rest = at % PERIOD
    at = at[np.isin(rest, COVER)] if len(COVER) != 3 else at[(rest == COVER[0]) | (rest == COVER[1]) | (rest == COVER[2])]
    return at, windows(h, at, _ANCHOR)


def _each(texts: list[bytes]):
    """(index, word hashes) of every text."""
    for i, counts, h in hashed(texts):
        ends = np.cumsum(counts)
        for k, (b, e) in enumerate(zip(ends - counts, ends, strict=True)):
            yield i + k, h[b:e]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal values."""
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1 if len(sorted_values) else []
    edges = [0, *cuts, len(sorted_values)]
    return [(int(sorted_values[b]), int(b), int(e)) for b, e in zip(edges, edges[1:], strict=False) if e > b]


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _grouped(ids: np.ndarray, second: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the entries by window, each window's in order of id, and which of them are the first of their window."""
    order = np.lexsort((ids, second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    return order, new


def _joined(table: pa.Table, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    """The packed arrays of some columns, joined over all rows."""
    return {k: np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in table[k].to_pylist())]) for k, t in kinds.items()}


_WINDOWS = {"first": U64, "second": np.uint32, "least": np.int64}


class _Repeats:
    """The windows that repeat, ready to be found in texts."""

    def __init__(self, first: np.ndarray, second: np.ndarray, least: np.ndarray):
        order = np.lexsort((second, first))
        self.first, self.second, self.least = first[order], second[order], least[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(first >> U64(44)).astype(np.int64)] = True

    def places(self, h: np.ndarray, own: int) -> np.ndarray:
        """Where windows start that a smaller doc_id than own has as well."""
        if len(h) < WINDOW or not len(self.first):
            return np.zeros(0, np.int64)
        f = windows(h, np.arange(len(h) - WINDOW + 1), _WINDOW)
        at = np.flatnonzero(self.bits[(f >> U64(44)).astype(np.int64)])
        at = at[_within(f[at], self.first)]
        f, s, found = f[at], (windows(h, at, _SECOND) >> U64(32)).astype(np.uint32), np.zeros(len(at), bool)
        entry = np.searchsorted(self.first, f)
        while True:  # more than once only where two windows share their first hash
            same = entry < len(self.first)
            same[same] = self.first[entry[same]] == f[same]
            if not same.any():
                return at[found]
            hit = np.flatnonzero(same)
            found[hit] |= (self.second[entry[hit]] == s[hit]) & (self.least[entry[hit]] < own)
            entry = np.where(same, entry + 1, len(self.first))


def _table(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.table({k: pa.array(v, schema.field(k).type) for k, v in columns.items()}, schema)


def deduplicate(docs: DataFrame, chunk_bytes: int = CHUNK, bucket_bytes: int = BUCKET, total: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words kept, joined by one space) of every row of docs (doc_id, text). total: bytes of all texts, where they are known."""
    prepare(docs.sparkSession)
    total = text_bytes(docs) if total is None else total
    n_chunks, n_buckets = groups_for(total, chunk_bytes), groups_for(total, bucket_bytes)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if base.agg(F.max("doc_id")).first()[0] == _LAST:  # no number is left to stand for null: ids give way to their places in order
        names = cut(ordered_numbers(base.select("doc_id").where("doc_id is not null").distinct(), "doc_id", name="place"))
        placed = base.join(names, "doc_id", "left").select(F.col("place").alias("doc_id"), "text")
        done = deduplicate(placed, chunk_bytes, bucket_bytes, total).withColumnRenamed("doc_id", "place")
        return done.join(names, "place", "left").select("doc_id", "n_words", "n_removed", "kept")
    repeated = not base.groupBy("doc_id").count().where("count > 1").isEmpty()
    base = base.groupBy("doc_id", "text").agg(F.count("*").alias("copies")) if repeated else base.withColumn("copies", F.lit(1).cast("long"))
    base = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int"))

    anchors_of = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])

    def gather(key, table):
        _, texts = _docs(table)
        found = [np.unique(_anchors(h)[1]) for _, h in _each(texts)]
        values, counts = np.unique(np.concatenate([np.zeros(0, U64), *found]), return_counts=True)
        out = {k: [] for k in anchors_of.names}
        for b, begin, end in _runs(_bucket(values, n_buckets)):
            v, c = values[begin:end], counts[begin:end]
            for k, x in (("bucket", b), ("chunk", key[0].as_py()), ("once", v[c == 1].tobytes()), ("more", v[c > 1].tobytes())):
                out[k].append(x)
        return _table(out, anchors_of)

    shared_of = pa.schema([("chunk", pa.int32()), ("hashes", pa.binary())])

    def match(table):
        once, more = ([np.frombuffer(x, U64) for x in table[k].to_pylist()] for k in ("once", "more"))
        every = np.sort(np.concatenate([np.zeros(0, U64), *once, *more, *more]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = {"chunk": [], "hashes": []}
        for chunk, a, b in zip(table["chunk"].to_pylist(), once, more, strict=True):
            if len(x := np.concatenate([a[_within(a, twice)], b])):
                out["chunk"].append(chunk)
                out["hashes"].append(x.tobytes())
        return _table(out, shared_of)

    windows_of = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("least", pa.binary()), ("several", pa.binary())])

    def extend(key, table, marks):
        out = {k: [] for k in windows_of.names}
        if not table.num_rows or not marks.num_rows:
            return _table(out, windows_of)
        shared = np.sort(np.concatenate([np.frombuffer(x, U64) for x in marks["hashes"].to_pylist()]))
        ids, texts = _docs(table)
        first, second, own = [], [], []
        for i, h in _each(texts):
            at, a = _anchors(h)
            at = at[_within(a, shared)]
            if not len(at):
                continue
            near = np.zeros(len(h) + 1, np.int64)  # windows that hold such an anchor start up to PERIOD - 1 words before it
            np.add.at(near, np.maximum(at - (WINDOW - ANCHOR), 0), 1)
            np.add.at(near, at + 1, -1)
            w = np.flatnonzero(np.cumsum(near)[: len(h) - WINDOW + 1] > 0)
            first.append(windows(h, w, _WINDOW))
            second.append((windows(h, w, _SECOND) >> U64(32)).astype(np.uint32))
            own.append(np.full(len(w), ids[i]))
        if not first:
            return _table(out, windows_of)
        first, second, own = map(np.concatenate, (first, second, own))
        order, new = _grouped(own, second, first)
        begins = np.flatnonzero(new)
        ends = np.append(begins, len(order))[1:] - 1
        first, second, least = first[order[begins]], second[order[begins]], own[order[begins]]
        several = own[order[ends]] != least
        for b, begin, end in _runs(_bucket(first, n_buckets)):  # buckets rise with hashes
            o = slice(begin, end)
            for k, x in (("bucket", b), ("chunk", key[0].as_py()), ("first", first[o].tobytes()), ("second", second[o].tobytes()), ("least", least[o].tobytes()), ("several", several[o].tobytes())):
                out[k].append(x)
        return _table(out, windows_of)

    repeats_of = pa.schema([("chunk", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("least", pa.binary())])

    def decide(table):
        x = _joined(table, _WINDOWS | {"several": bool})
        order, new = _grouped(x["least"], x["second"], x["first"])
        least = np.empty(len(order), np.int64)
        least[order] = x["least"][order][np.flatnonzero(new)][np.cumsum(new) - 1]
        wanted = x["several"] | (least < x["least"])
        out, at = {k: [] for k in repeats_of.names}, 0
        for chunk, size in zip(table["chunk"].to_pylist(), (len(y) for y in table["several"].to_pylist()), strict=True):
            m = at + np.flatnonzero(wanted[at : at + size])
            at += size
            if len(m):
                for k, y in (("chunk", chunk), ("first", x["first"][m].tobytes()), ("second", x["second"][m].tobytes()), ("least", least[m].tobytes())):
                    out[k].append(y)
        return _table(out, repeats_of)

    kept_of = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("copies", pa.int64())])

    def remove(key, table, marks):
        out = {k: [] for k in kept_of.names}
        if not table.num_rows:
            return _table(out, kept_of)
        ids, texts = _docs(table)
        repeats = _Repeats(**_joined(marks, _WINDOWS))
        hashes = _each(texts) if len(repeats.first) else ((i, np.zeros(0, U64)) for i in range(len(texts)))
        for (i, h), copies in zip(hashes, table["copies"].to_pylist(), strict=True):
            w = texts[i].split()
            n, starts = len(w), repeats.places(h, ids[i])
            if len(starts):
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + WINDOW, -1)
                w = [w[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
            for k, x in (("doc_id", None if ids[i] == _LAST else int(ids[i])), ("n_words", n), ("n_removed", n - len(w)), ("kept", b" ".join(w).decode("utf-8", "replace")), ("copies", copies)):
                out[k].append(x)
        return _table(out, kept_of)

    by_chunk = base.groupBy("chunk")
    anchors = by_chunk.applyInArrow(gather, "bucket int, chunk int, once binary, more binary")
    shared = anchors.groupBy("bucket").applyInArrow(match, "chunk int, hashes binary")
    candidates = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(extend, "bucket int, chunk int, first binary, second binary, least binary, several binary")
    repeats = candidates.groupBy("bucket").applyInArrow(decide, "chunk int, first binary, second binary, least binary")
    done = by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string, copies long")
    return _given_out(done, COPIES) if repeated else done.drop("copies")


def _given_out(rows: DataFrame, each: int) -> DataFrame:
    """Each row as often as its copies say; many copies are dealt over tasks, `each` at a time."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(each).cast("long")))
    parts = rows.withColumn("at", part).repartition(F.xxhash64("doc_id", "at"))
    return parts.withColumn("copy", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + each, F.col("copies")) - 1))).drop("copies", "at", "copy")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text)."""
    total = text_bytes(docs)
    short = deduplicate(docs, total=total).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
    return few_files(short, total)
