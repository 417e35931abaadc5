"""Operator 1: toxicity, a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of NGRAMS bytes of the lower-cased text with white space folded to
single spaces, hashed into 2^BITS slots. Each slot is scaled by the log ratio of its smoothed
document frequencies in toxic and clean texts; logistic regression on the scaled features gives the
weights. Slots too rare to tell or without a clear ratio have weight zero. The model is two
arrays of fixed size, sent to the executors whatever the number of documents; scoring is one pass without a shuffle.

The model is fitted on a bounded sample: at most PER_CLASS labelled rows of each label, those with
the least hash of doc_id, and of these never a row that is held out. Several labels of one doc_id count by
their maximum. Without rows of both labels every score is the share of toxic ones (0 without any).

Nulls and empty texts have no features; their score is that of the intercept. A null doc_id is
scored and counts as not held out. Repeated rows are scored each; an empty table gives an empty one;
further columns are not read. Texts are scored whole, whatever their length.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, cut, factors, few_files, prepare, text_bytes

NGRAMS, BITS = (4, 5, 6), 20

#: Labelled rows of each label that the model is fitted on, at most.
PER_CLASS = 2500

#: predicted is 1 from this score on.
THRESHOLD = 0.7

_BY = factors(max(NGRAMS), 17)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[9, 10, 11, 12, 13]] = 32


def _bytes(text: str | None) -> np.ndarray:
    raw = _FOLD[np.frombuffer(b" " + (text or "").lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)]
    return raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])]


def _slots(raw: np.ndarray, ngrams: tuple[int, ...], bits: int):
    """The slots of the n-grams of a text, one array for each n."""
    total, wide = np.zeros(max(0, len(raw)), np.uint64), raw.astype(np.uint64) + U64(1)
    for k in range(max(ngrams)):
        if len(raw) <= k:
            return
        total = total[: len(raw) - k] + wide[k:] * _BY[k]
        if k + 1 in ngrams:
            x = total ^ (total >> U64(29))
            yield ((x * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int64)


@dataclasses.dataclass
class Model:
    weights: np.ndarray  # of each slot, the ratio included
    intercept: float
    ngrams: tuple[int, ...] = NGRAMS
    bits: int = BITS

    #: Bytes of a text looked at together; slots seen are kept from one part to the next.
    part = 1 << 20

    def score(self, text: str | None) -> float:
        raw, found = _bytes(text), []
        for at in range(0, len(raw), self.part):
            for slots in _slots(raw[max(0, at - max(self.ngrams) + 1) : at + self.part], self.ngrams, self.bits):
                w = self.weights[slots]
                found.append(np.unique(slots[w != 0]))
        x = float(self.weights[np.unique(np.concatenate(found))].sum(dtype=np.float64)) + self.intercept if found else self.intercept
        return 1 / (1 + float(np.exp(-np.clip(x, -60, 60))))


def _ratio(toxic_with, clean_with, toxic, clean, smooth, log, sqrt):
    """Log ratio of the smoothed frequencies of a slot in toxic and clean texts, and its standard error; for arrays and for columns."""
    ratio = log((toxic_with + smooth) / (toxic + 2 * smooth)) - log((clean_with + smooth) / (clean + 2 * smooth))
    return ratio, sqrt(1 / (toxic_with + smooth) + 1 / (clean_with + smooth) - 1 / (toxic + 2 * smooth) - 1 / (clean + 2 * smooth))


def train(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, ridge: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on sets of scaled features, both labels weighing alike."""
    row, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    balance = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    n = len(scale)
    w, b, m1, v1, mb, vb = np.zeros(n), 0.0, np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam on the whole sample
        z = np.bincount(row, (w * scale)[column], len(rows)) + b
        g = balance * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        gw, gb = scale * np.bincount(column, g[row], n) + ridge * w, g.sum()
        m1, v1, mb, vb = 0.9 * m1 + 0.1 * gw, 0.99 * v1 + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.05 * (1 - step / (steps + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w, b = w - rate * m1 / (np.sqrt(v1) + 1e-8), b - rate * mb / (np.sqrt(vb) + 1e-8)
    return w * scale, float(b)


def held_out() -> Column:
    """Whether the checksum of a doc_id falls on the third that no label is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, smooth: float = 1.0, least: int = 3, clear: float = 3.5) -> Model:
    """The model of labelled documents (doc_id, text) and labels (doc_id, toxic). clear: standard errors by which a slot's log ratio must differ from zero. What reaches the driver is bounded: at most 2^BITS slots, and the slots in use of 2 * per_class texts."""
    prepare(docs.sparkSession)
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    chosen = [marked.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (1, 0)]
    # the sample's ids are at most 2 * per_class rows, so they can be sent to all executors
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    sample = cut(sample.dropDuplicates(["doc_id"]).select("y", "text"), 8)  # a bounded sample needs few files
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    weights = np.zeros(1 << BITS, np.float32)
    if not toxic or not clean:
        return Model(weights, 60.0 if toxic else -60.0)

    def count(batches):
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for y, text in zip(batch["y"].to_pylist(), batch["text"].to_pylist(), strict=True):
                seen[y, slots_of(text)] += 1
        slots = np.flatnonzero(seen.any(axis=0))
        for at in range(0, len(slots), 65536):
            part = slots[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(seen[v, part]) for v in (1, 0))], names=["slot", "toxic", "clean"])

    counts = sample.mapInArrow(count, "slot int, toxic int, clean int").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio, error = _ratio(F.col("toxic"), F.col("clean"), toxic, clean, smooth, F.log, F.sqrt)
    used = counts.where(F.col("toxic") + F.col("clean") >= least).where(F.abs(ratio) > clear * error).select("slot", ratio.alias("ratio")).toArrow().sort_by("slot")
    slots, scale = used["slot"].to_numpy(), used["ratio"].to_numpy()
    place = np.full(1 << BITS, -1, np.int32)
    place[slots] = np.arange(len(slots))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def narrow(batches):
        for batch in batches:
            found = [shared.value[slots_of(t)] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array([x[x >= 0].astype(np.int32).tobytes() for x in found], pa.binary())], names=["y", "slots"])

    rows = sample.mapInArrow(narrow, "y int, slots binary").toArrow()
    sets = sorted(zip(rows["y"].to_pylist(), rows["slots"].to_pylist(), strict=True))  # an order that does not depend on the run
    weights[slots], intercept = train([np.frombuffer(x, np.int32) for _, x in sets], np.array([y for y, _ in sets], np.float64), scale)
    return Model(weights, intercept)


def slots_of(text: str | None) -> np.ndarray:
    """The distinct slots of a text."""
    raw, found = _bytes(text), [np.zeros(0, np.int64)]
    for at in range(0, len(raw), Model.part):
        found += [np.unique(x) for x in _slots(raw[max(0, at - max(NGRAMS) + 1) : at + Model.part], NGRAMS, BITS)]
    return np.unique(np.concatenate(found))


def score(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """docs with the score of each text as a further column; one of that name is replaced."""
    prepare(docs.sparkSession)
    shared, docs = docs.sparkSession.sparkContext.broadcast(model), docs.drop(to)

    def run(batches):
        for batch in batches:
            scores = pa.array([shared.value.score(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, to])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels))
    short = scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
    return few_files(short, text_bytes(docs))
