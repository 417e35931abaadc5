"""Operator 13: quality, a Bradley-Terry ranking learned from pairs of documents.

A pair is a document marked as good and one marked as bad; the model says that the first is preferred with
probability 1 / (1 + exp(-(s1 - s2))), where s is linear in features of the text. The weights are those of a logistic regression
without intercept on differences of features: a ridge keeps them finite, Newton steps find them.

Features describe form, not content: frequencies of pairs of neighbouring character classes (as square roots), and shares of
words that repeat the word before, that are distinct within blocks of BLOCK words, that are written in capitals, that are very long,
of lines that differ, and mean lengths. They are found over the whole text, part by part, so memory does not grow with a text.

All labelled rows that have a document and are not held out are learned from. They are dealt into groups of about GROUP rows of the larger side by a hash of doc_id;
each of these meets PARTNERS rows of the other side that are in its group. Rows of a side that is too small to fill the groups stand in several. Each Newton step is
one pass over the groups, in tasks; one sum a task goes to the driver, of the size of the model's squared. Several marks of one doc_id count by the least,
several texts of one doc_id by the one with the least SHA-256. The threshold is a quantile of the scores of all labelled rows: with the rows weighing as their
marks do among all labelled rows, also those without words, the share of bad ones lies below it. That quantile gets the score THRESHOLD.
Without rows of both marks every text with words scores 1 where only good ones are marked, else 0; 1 without any mark.

A null, an empty text and one of white space alone lose against every text: 0. A null doc_id is scored and counts as
not held out. Repeated rows are scored each; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, encoded, prepare, words

#: Rows of the larger side in a group, rows of the other that a group has at least on average, and partners of a row.
GROUP, OTHERS, PARTNERS = 4096, 64, 6

#: Tasks that sum up a step, at most, and strengths that the driver looks at together.
TASKS, STRENGTHS = 64, 10_000

#: predicted is 1 from this score on.
THRESHOLD = 0.3

#: Words in a block of which distinct ones are counted; letters that make a word long; bytes of a text looked at together.
BLOCK, LONG, PART = 64, 24, 1 << 20

_CLASSES = [b" ", b"\n\r\v\f", b"\t", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"'\"-", b"()[]{}<>", b"|", b"#$%&*+/=@\\^_`~:;", bytes(range(128, 256))]
_CLASS = np.full(256, 2, np.uint8)  # other control characters go with tabs
for _k, _of in enumerate(_CLASSES):
    _CLASS[list(_of)] = _k
N_CLASSES, N_WORDS = len(_CLASSES), 8
N_FEATURES = N_CLASSES**2 + N_WORDS
_UPPER, _LETTER = _CLASSES.index(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), np.isin(np.arange(N_CLASSES), [3, 4, 13])


def _parts(data: bytes):
    """Parts of about PART bytes; they end after white space, or after two parts' length in texts without any."""
    at = 0
    while at < len(data):
        end = min(at + PART, len(data))
        while end < min(at + 2 * PART, len(data)) and data[end - 1] not in b" \t\n\r\v\f":
            end += 1
        yield data[at:end]
        at = end


def features(text: str | None) -> np.ndarray | None:
    """The features of a text; None where it has no words."""
    pairs, data = np.zeros(N_CLASSES**2, np.int64), encoded(text)
    n = same = capitals = long = letters = blocks = 0
    distinct, last, before_c, rest = 0.0, None, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for part in _parts(data):
        c = _CLASS[np.frombuffer(part, np.uint8)].astype(np.int64)
        both, before_c = np.concatenate([before_c, c]), c[-1:]
        pairs += np.bincount(both[:-1] * N_CLASSES + both[1:], minlength=N_CLASSES**2)
        starts, ends, h = words(part)
        if not len(h):
            continue
        before = np.concatenate([[h[0] + np.uint64(1) if last is None else last], h[:-1]])
        n, same, last = n + len(h), same + int((h == before).sum()), h[-1]
        size = ends - starts
        letters, long = letters + int(size.sum()), long + int((size > LONG).sum())
        upper, any_letter = (np.concatenate([[0], np.cumsum(x)]) for x in (c == _UPPER, _LETTER[c]))
        big, of = upper[ends] - upper[starts], any_letter[ends] - any_letter[starts]
        capitals += int(((big > 1) & (2 * big > of)).sum())
        h = np.concatenate([rest, h])
        whole = len(h) // BLOCK
        distinct, blocks = distinct + sum(len(set(b)) for b in h[: whole * BLOCK].reshape(whole, BLOCK).tolist()) / BLOCK, blocks + whole
        rest = h[whole * BLOCK :]
    if not n:
        return None
    if len(rest):
        distinct, blocks = distinct + len(set(rest.tolist())) / len(rest), blocks + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    shares = [same / n, distinct / blocks, capitals / n, long / n, len(set(lines)) / max(1, len(lines)), np.log1p(letters / n), np.log1p(n), np.log1p(n / max(1, len(lines)))]
    return np.concatenate([np.sqrt(pairs / max(1, pairs.sum())), shares])


@dataclasses.dataclass
class Model:
    weights: np.ndarray  # of standardised features
    mean: np.ndarray
    spread: np.ndarray
    threshold: float  # the strength that gets the score THRESHOLD

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def score(self, text: str | None) -> float:
        if (x := features(text)) is None:
            return 0.0
        z = float(self.strength(x)) - self.threshold + np.log(THRESHOLD / (1 - THRESHOLD))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def pairs_of(good: int, bad: int, partners: int = PARTNERS) -> tuple[np.ndarray, np.ndarray]:
    """Preference pairs (a good row, a bad row): each row of the larger side meets `partners` of the other, evenly spread."""
    most, least = max(good, bad), min(good, bad)
    row = np.arange(most)
    shifts = [(row + k * max(1, least // partners)) % least for k in range(min(partners, least))]
    many, few = np.tile(row, len(shifts)), np.concatenate(shifts)
    return (many, few) if good >= bad else (few, many)


def slope(w: np.ndarray, differences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood that the first of each pair is preferred, and minus its second derivative."""
    p = 1 / (1 + np.exp(np.clip(differences @ w, -30, 30)))  # probability of the other order
    return differences.T @ p, (differences * (p * (1 - p))[:, None]).T @ differences


def newton(slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """The weights at which the gradient vanishes; `slopes` gives it for all pairs."""
    w, eye = np.zeros(size), np.eye(size)
    for _ in range(steps):
        gradient, curvature = slopes(w)
        move = np.linalg.solve(curvature + ridge * eye, gradient - ridge * w)
        w = w + move * min(1.0, 4 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-6:
            break
    return w


def train(differences: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """The weights under which the first of each pair is preferred: logistic loss on differences of features, Newton's method."""
    return newton(lambda w: slope(w, differences), differences.shape[1], ridge, steps)


def quantile(strengths: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The middle of the two strengths between which the weights reach a share of their sum."""
    order = np.argsort(strengths, kind="stable")
    reached = np.cumsum(weights[order]) / weights.sum()
    at = min(int(np.searchsorted(reached, share - 1e-12)), len(order) - 1)
    return float(strengths[order[at : at + 2]].mean())


def quantile_of(strengths: DataFrame, weights: tuple[float, float], share: float) -> float:
    """The quantile of a table of strengths (s, y), rows of mark y weighing weights[y]. Equal strengths are put together; where too many differ, counts in 1,000 ranges tell which of them to look into, again and again."""
    light = min(weights)
    values = cut(strengths.groupBy("s").agg(F.count_if(F.col("y") == 0).alias("bad"), F.count_if(F.col("y") == 1).alias("good")), TASKS)
    weight = F.col("bad") * weights[0] + F.col("good") * weights[1]
    low, high, n, total = values.agg(F.min("s"), F.max("s"), F.count("*"), F.sum(weight)).first()
    below, upto = 0.0, F.col("s") <= high  # weight of all that is less than low
    while n > STRENGTHS and low < high:
        step = (high - low) / 1000
        place = F.least(F.floor((F.col("s") - low) / step), F.lit(999))
        ranges = values.where((F.col("s") >= low) & upto).groupBy(place.alias("place")).agg(F.min("s").alias("low"), F.max("s").alias("high"), F.count("*").alias("n"), F.sum(weight).alias("w")).orderBy("place").collect()
        for r in ranges:
            if below + r["w"] >= (share - 1e-12) * total or r is ranges[-1]:
                break
            below += r["w"]
        low, high, n, upto = r["low"], r["high"], r["n"], F.col("s") <= r["high"]
    inside = values.where((F.col("s") >= low) & upto).select("s", "bad", "good").toArrow().sort_by("s").to_pylist()
    after = values.where(F.col("s") > high).agg(F.min("s")).first()[0]
    found = [(low - 1, below)] if below else []
    for r in inside:  # the last row of equal ones by itself
        last = light if r["bad"] and r["good"] else weights[1] if r["good"] else weights[0]
        whole = r["bad"] * weights[0] + r["good"] * weights[1]
        found += [(r["s"], whole - last), (r["s"], last)] if r["bad"] + r["good"] > 1 else [(r["s"], whole)]
    if after is not None:
        found.append((after, total - sum(w for _, w in found)))
    return quantile(np.array([s for s, _ in found]), np.array([w for _, w in found]), share)


def held_out() -> Column:
    """Whether the checksum of a doc_id falls on the fifth that no label is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of documents (doc_id, text) and labels (doc_id, quality), from all rows of both that are not held out."""
    prepare(docs.sparkSession)
    marked = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("y"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and doc_id is not null")
    marked = cut(marked.join(docs.select("doc_id"), "doc_id", "left_semi"), TASKS)
    n = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.ones(N_FEATURES), -60.0 if n.get(1) or not n else 60.0)
    groups = -(-max(n.values()) // GROUP)
    several = 1 if groups == 1 else min(groups, -(-OTHERS * groups // min(n.values())))  # groups that a row of the smaller side stands in

    def describe(batches):
        for batch in batches:
            found = [features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array([None if x is None else x.astype(np.float32).tobytes() for x in found], pa.binary())], names=["doc_id", "mark", "x"])

    # features are made before the join, so no text is shuffled
    described = docs.where(~held_out()).select("doc_id", F.sha2("text", 256).alias("mark"), "text").mapInArrow(describe, "doc_id long, mark string, x binary")
    known = described.join(marked, "doc_id").groupBy("doc_id", "y").agg(F.min_by("x", "mark").alias("x")).where("x is not null")
    smaller = 1 if n[1] <= n[0] else 0
    turn = F.explode(F.sequence(F.lit(0), F.when(F.col("y") == smaller, several - 1).otherwise(0)))
    dealt = known.select("doc_id", "y", "x", turn.alias("turn")).withColumn("group", F.pmod(F.xxhash64("doc_id") + F.col("turn"), F.lit(groups)).cast("int"))
    dealt = cut(dealt.repartition(min(groups, TASKS), "group").sortWithinPartitions("group", "doc_id"))

    def summed(run, size: int) -> np.ndarray:
        """The sum, over all groups, of what run(y, x, turn) gives for one: one row a task, added up in the order of tasks."""

        def each(batches):
            total, group, rows = np.zeros(size), None, []

            def done():
                y, turn = (np.concatenate([r[k] for r in rows]) for k in (0, 2))
                return run(y, np.concatenate([r[1] for r in rows]), turn)

            for b in batches:
                ids, y, turn = (b[c].to_numpy() for c in ("group", "y", "turn"))
                x = np.frombuffer(b"".join(b["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
                for at in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1):
                    if not len(at):
                        continue
                    if rows and ids[at[0]] != group:
                        total, rows = total + done(), []
                    group = ids[at[0]]
                    rows.append((y[at], x[at], turn[at]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([(total + done()).tobytes()], pa.binary())], names=["sum"])

        parts = dealt.select("group", "y", "turn", "x").mapInArrow(each, "sum binary").collect()
        return sum((np.frombuffer(r["sum"], np.float64) for r in parts), np.zeros(size))

    def moments(y, x, turn):
        own = x[turn == 0]
        return np.concatenate([own.sum(axis=0), (own * own).sum(axis=0), [(y[turn == 0] == v).sum() for v in (0, 1)]])

    found = summed(moments, 2 * N_FEATURES + 2)
    bad, good = found[-2:]
    if not bad or not good:
        return Model(np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.ones(N_FEATURES), -60.0)
    mean = found[:N_FEATURES] / (bad + good)
    spread = np.maximum(np.sqrt(np.maximum(found[N_FEATURES:-2] / (bad + good) - mean**2, 0)), 1e-3)

    def slopes(w):
        def run(y, x, turn):
            z = (x - mean) / spread
            one, other = z[y == 1], z[y == 0]
            out = np.zeros(N_FEATURES * (N_FEATURES + 1))
            if len(one) and len(other):
                first, second = pairs_of(len(one), len(other))
                for at in range(0, len(first), GROUP):
                    gradient, curvature = slope(w, one[first[at : at + GROUP]] - other[second[at : at + GROUP]])
                    out += np.concatenate([gradient, curvature.reshape(-1)])
            return out

        total = summed(run, N_FEATURES * (N_FEATURES + 1))
        return total[:N_FEATURES], total[N_FEATURES:].reshape(N_FEATURES, N_FEATURES)

    w = newton(slopes, N_FEATURES)

    def strong(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b["y"], pa.array(np.einsum("ij,j->i", (x - mean) / spread, w))], names=["y", "s"])

    strengths = dealt.where("turn = 0").select("y", "x").mapInArrow(strong, "y int, s double")
    return Model(w, mean, spread, quantile_of(strengths, (n[0] / bad, n[1] / good), n[0] / (n[0] + n[1])))


def score(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """docs with the score of each text as a further column; one of that name is replaced. One pass without a shuffle; the model is a few kilobytes."""
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
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
