"""Operator 4: cross-entropy difference of two n-gram language models.

The target model is counted over the documents that are labelled as good, the background model over
all other documents. Both share one vocabulary, the 256 byte values of lower-cased UTF-8 text. Sequences of one to four
bytes are counted exactly, and probabilities interpolate all four orders by Dirichlet smoothing. The models are matched: order
and smoothing are the same, and the counts of the corpus with more tokens are scaled to the tokens of the other, so that
both know as much; that is what a sample of that size would hold on average, without leaving a document out. A document's score is the
mean over its tokens of target loss less background loss, in bits: the lower, the more like the target.

Documents are dealt into groups of about 16 MB. Each group counts its distinct sequences, packed by buckets of the two
bytes in their middle; a bucket holds all that the loss of its sequences needs but pairs and single bytes, adds up the counts of all groups and
answers each group with the losses of its own sequences. The counts grow with the corpus and are never in one place:
a group meets only the sequences that it has. Pairs and single bytes, 65,792 counts a model, are summed up by slices and sent to all executors.

Nulls and empty texts have no tokens: their losses and their difference are null. Without any target document the
target model is the uniform one, and the background is not scaled. Several labels of a doc_id count by their maximum; rows without doc_id are
background only. Repeated rows count and are scored each. Texts of any length are counted and scored whole. Rows of one doc_id, and
rows without doc_id of one text, are in one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, encoded, few_files, groups_for, prepare, text_bytes

ORDER = 4

#: Weight of the lower order, in tokens.
SMOOTH = 4.0

#: Where the counts of pairs and of single bytes begin.
_AT2 = 0
_AT1 = _AT2 + 65536
SLICE = 1 << 12

#: Bytes of a text that are looked at together, and of sequences that are sorted together.
PART = 1 << 18
WAIT = 1 << 21


def _parts(text: str | None):
    """Parts of a text as bytes, each with the ORDER - 1 bytes before it; a text begins after line feeds."""
    raw = np.frombuffer(b"\n" * (ORDER - 1) + encoded(text.lower()) if text else b"", np.uint8)
    for at in range(ORDER - 1, len(raw), PART):
        yield raw[at - ORDER + 1 : at + PART]


def _grams(raw: np.ndarray) -> np.ndarray:
    """For each byte after the first three: its sequence of four bytes as a number."""
    wide = raw.astype(np.uint32)
    return wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]


def _middle(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint32(8)) & np.uint32(0xFFFF)


def _sums(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each key the sums of counts, one row a model, over all equal keys."""
    of = np.unique(keys, return_inverse=True)[1]
    return np.stack([np.bincount(of, c) for c in counts])[:, of]


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the smallest type that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}")


class _Tally:
    """Exact counts of sequences, one row a model: target and background."""

    def __init__(self):
        self.grams, self.counts, self.held, self.waiting = np.zeros(0, np.uint32), np.zeros((2, 0), np.int64), [], 0

    def add(self, grams: np.ndarray, good: bool) -> None:
        self.held.append((grams, good))
        self.waiting += len(grams)
        if self.waiting > max(WAIT, len(self.grams)):
            self.settle()

    def settle(self) -> None:
        grams, counts = [self.grams], [self.counts]
        for good in (False, True):
            if found := [g for g, x in self.held if x == good]:
                g, n = np.unique(np.concatenate(found), return_counts=True)
                grams.append(g)
                counts.append(np.stack([n, np.zeros_like(n)] if good else [np.zeros_like(n), n]))
        self.held, self.waiting = [], 0
        self.grams, of = np.unique(np.concatenate(grams), return_inverse=True)
        every = np.concatenate(counts, axis=1)
        self.counts = np.stack([np.bincount(of, c, len(self.grams)).astype(np.int64) for c in every])


def _dealt(rows: DataFrame, total: int) -> DataFrame:
    """rows with their group: by doc_id; rows without one by text."""
    key = F.xxhash64("doc_id")
    if "text" in rows.columns:
        key = F.when(F.col("doc_id").isNotNull(), key).otherwise(F.xxhash64("text"))
    return rows.withColumn("part", F.pmod(key, F.lit(groups_for(total, 16 << 20))).cast("int"))


def _documents(docs: DataFrame, total: int) -> DataFrame:
    return _dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), total)


def counted(docs: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """part, bucket, grams, target, background: the packed counts of each group of docs (doc_id, text), with labels (doc_id, quality) of 1 for the target. The buckets grow with `total`, the bytes of all texts."""
    prepare(docs.sparkSession)
    buckets = min(65536, groups_for(total, 64 << 20, 64))
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality >= 1").select("doc_id")

    def gather(key, rows, wanted):
        tally, ids = _Tally(), set(wanted["doc_id"].to_pylist())
        for batch in rows.to_batches(256):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                for raw in _parts(text.as_py()):
                    tally.add(_grams(raw), doc_id in ids)
        tally.settle()
        bucket = (_middle(tally.grams) * np.uint32(40503) & np.uint32(0xFFFF)) * np.uint64(buckets) >> np.uint64(16)
        order = np.argsort(bucket, kind="stable")
        grams, counts, bucket = tally.grams[order], tally.counts[:, order], bucket[order]
        names, first = np.unique(bucket, return_index=True)
        ends = np.append(first, len(bucket))[1:]
        return pa.table(
            {
                "part": pa.array([key[0].as_py()] * len(names), pa.int32()), "bucket": pa.array(names.astype(np.int32)), "grams": pa.array([grams[b:e].tobytes() for b, e in zip(first, ends, strict=True)], pa.binary()),
                **{name: pa.array([_narrow(counts[v, b:e]) for b, e in zip(first, ends, strict=True)], pa.binary()) for v, name in enumerate(("target", "background"))},
            }
        )

    return _documents(docs, total).groupBy("part").cogroup(_dealt(good, total).groupBy("part")).applyInArrow(gather, "part int, bucket int, grams binary, target binary, background binary")


def _unpacked(table) -> tuple[list[np.ndarray], np.ndarray]:
    """The sequences of each row of packed counts, and the counts of all, one row a model."""
    grams = [np.frombuffer(g, np.uint32) for g in table["grams"].to_pylist()]
    return grams, np.stack([np.concatenate([np.zeros(0), *(_wide(c, len(g)) for c, g in zip(table[name].to_pylist(), grams, strict=True))]) for name in ("target", "background")])


def lower(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of pairs and of single bytes, target and background, from packed counts: 65,792 a model, whatever the corpus."""

    def gather(batches):
        seen = np.zeros((2, 65536), np.int64)
        for batch in batches:
            grams, found = _unpacked(batch)
            pairs = np.concatenate([np.zeros(0, np.uint32), *grams]) & np.uint32(0xFFFF)
            for v in (0, 1):
                seen[v] += np.bincount(pairs, found[v], 65536).astype(np.int64)
        for v in (0, 1):
            for at in range(0, 65536, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()), pa.array([at], pa.int32()), pa.array([seen[v, at : at + SLICE].tobytes()], pa.binary())], names=["model", "at", "counts"])

    def add_up(key, table):
        total = np.sum([np.frombuffer(c, np.int64) for c in table["counts"].to_pylist()], axis=0)
        return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    pairs = np.zeros((2, 65536), np.int64)
    for row in counts.mapInArrow(gather, "model int, at int, counts binary").groupBy("model", "at").applyInArrow(add_up, "model int, at int, counts binary").collect():
        pairs[row["model"], row["at"] : row["at"] + SLICE] = np.frombuffer(row["counts"], np.int64)
    return tuple(np.concatenate([x, x.reshape(256, 256).sum(axis=0)]) for x in pairs)


def count(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of pairs and of single bytes of the target and of the background: docs (doc_id, text) with labels (doc_id, quality) of 1, and all others."""
    return lower(counted(docs, labels, text_bytes(docs)))


def _losses(grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bits that the last byte of each sequence takes, one row a model. grams are distinct and whole buckets; counts are theirs."""
    tokens = [c[_AT1:].sum() for c in low]
    scale = [min(1.0, tokens[1 - v] / tokens[v]) if all(tokens) else 1.0 for v in (0, 1)]
    counts, low = counts * np.array(scale)[:, None], [c * x for c, x in zip(low, scale, strict=True)]
    three, context3, context2 = (_sums(k, counts) for k in (grams & np.uint32(0xFFFFFF), grams >> np.uint32(8), _middle(grams)))
    out = np.empty(counts.shape)
    for v, c in enumerate(low):
        one = (c[_AT1:] + 1) / (c[_AT1:].sum() + 256)
        pairs = c[_AT2:_AT1].reshape(256, 256)
        two = ((pairs + SMOOTH * one) / (pairs.sum(axis=1, keepdims=True) + SMOOTH)).reshape(-1)[grams & np.uint32(0xFFFF)]
        p = (three[v] + SMOOTH * two) / (context2[v] + SMOOTH)
        out[v] = -np.log2((counts[v] + SMOOTH * p) / (context3[v] + SMOOTH))
    return out


def answers(counts: DataFrame, low: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """part, grams, target, background: for each row of packed counts the losses of its sequences, by the counts of all rows."""
    shared = counts.sparkSession.sparkContext.broadcast(low)

    def answer(table):
        grams, found = _unpacked(table)
        every, of = np.unique(np.concatenate(grams), return_inverse=True)
        losses = _losses(every, np.stack([np.bincount(of, c) for c in found]), shared.value)
        ends = np.cumsum([len(g) for g in grams])
        return pa.table({"part": table["part"], "grams": table["grams"], **{name: pa.array([losses[v][of[e - len(g) : e]].tobytes() for g, e in zip(grams, ends, strict=True)], pa.binary()) for v, name in enumerate(("target", "background"))}})

    return counts.groupBy("bucket").applyInArrow(answer, "part int, grams binary, target binary, background binary")


def score(docs: DataFrame, losses: DataFrame, total: int) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference (bits a token) of every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)

    def run(key, rows, known) -> pa.Table:
        grams = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(g, np.uint32) for g in known["grams"].to_pylist())])
        order = np.argsort(grams)
        grams, bits = grams[order], [np.concatenate([np.zeros(0), *(np.frombuffer(x, np.float64) for x in known[name].to_pylist())])[order] for name in ("target", "background")]
        n, sums = [], ([], [])
        for batch in rows.to_batches(256):
            for text in batch["text"]:
                size, taken = 0, [0.0, 0.0]
                for raw in _parts(text.as_py()):
                    at = np.searchsorted(grams, _grams(raw))
                    size += len(at)
                    for v in (0, 1):
                        taken[v] += float(bits[v][at].sum())
                n.append(size)
                for v in (0, 1):
                    sums[v].append(taken[v] / size if size else None)
        difference = [None if a is None else a - b for a, b in zip(*sums, strict=True)]
        return pa.table({"doc_id": rows["doc_id"], "n_tokens": pa.array(n, pa.int64()), "target_loss": pa.array(sums[0], pa.float64()), "background_loss": pa.array(sums[1], pa.float64()), "difference": pa.array(difference, pa.float64())})

    return _documents(docs, total).groupBy("part").cogroup(losses.groupBy("part")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, difference double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The scores of docs by models that are counted on them."""
    total = text_bytes(docs)
    counts = cut(counted(docs, labels, total), groups_for(total, 32 << 20, 24))
    return few_files(score(docs, answers(counts, lower(counts)), total), total)
