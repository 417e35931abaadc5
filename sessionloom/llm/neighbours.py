"""Operator 5: nearest neighbours by a forest of random-projection trees.

Each tree halves the space by the direction between two random sample vectors, at the sample's median.
The trees are fitted on at most SAMPLE vectors, those with the least hash of vec_id, and every vector is
put into one leaf of each tree. A query walks all trees through one priority queue. The priority of a node is the
probability that a neighbour lies below it: at each split the neighbour is expected at the query's own projection times the
cosine that k-th neighbours have in the sample, give or take what the rest of it adds. Leaves are taken in that order
until a neighbour is in one of them with probability SURE, or FIRST leaves are taken. Vectors of these leaves are compared
exactly, in double precision.

That probability rests on the usual neighbour, and vectors need not be like the usual one, so an exact check follows. Each leaf of the first tree
has a centre and the widest angle between that and any of its vectors. A leaf that cannot, by these angles, hold a vector as near as the k-th
that the forest found is left out; all others are compared too. So the result is that of brute force. Where vectors form clusters few leaves
are left; of random directions hardly one can be left out, and the check is a scan in blocks, which grows with the square of their number.

Leaves of one subtree form a page; a query goes to a page once, with a mask of its leaves. Equal vectors are collapsed
before they are put into leaves: as ties go to the smaller vec_id, only the
k + 1 smallest of them can be among anyone's k nearest (one may be the query itself). Pages of more than
BLOCK vectors are dealt into blocks by a hash, its queries, if more than BLOCK, into parts, and each block meets each part. So no task sees more
than a block and a part, whatever the number of copies.

Vectors that are null, empty, zero or hold null or non-finite components take no part, neither do
rows without vec_id nor vectors of another length than most. Of rows with the same vec_id the nearest
counts. An empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

#: SAMPLE bounds the vectors that trees are fitted on, FOREST the bytes of all trees, which are sent to all executors.
TREES, SAMPLE, LEAF, BLOCK, FOREST = 8, 20_000, 32, 8192, 64 << 20

#: Probability at which a query's search ends, and leaves at which it goes over to the exact check.
SURE, FIRST = 0.97, 32

#: What rounding may take from a cosine in the exact check, and from a product of unit vectors before it is computed again.
SLACK, NEAR = 1e-7, 1e-9

#: Levels below a page: its leaves are the bits of a number.
PAGE = 5

_PAGES, _PAGES_SQL = pa.list_(pa.struct([("page", pa.int32()), ("mask", pa.int64())])), "pages array<struct<page:int,mask:long>>"

#: Queries that one task looks up leaves for.
LOOKED_UP = 128


def _below(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7, and never 0 or 1."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.clip(np.where(z >= 0, 1 - tail, tail), 1e-9, 1 - 1e-9)


def usual_cosine(sample: np.ndarray, k: int, total: int, queries: int = 256) -> float:
    """The median cosine between vectors and their k-th neighbours among `total`, as the sample tells: there that neighbour's rank is less in the same proportion, if at least 1. Equal vectors do not count."""
    rank = min(len(sample), max(1, round(k * len(sample) / max(total, 1))))
    s = sample[:queries] @ sample.T
    s[s > 1 - 1e-6] = -1
    return float(np.clip(np.median(np.partition(s, -rank, axis=1)[:, -rank]), 0.05, 0.99))


class Forest:
    """Complete binary trees: node i of a level array has children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, levels: int, trees: int, k: int = 5, total: int = 0, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.levels, self.trees, inner = levels, trees, (1 << levels) - 1
        self.cosine = usual_cosine(sample, k, max(total, len(sample)))
        self.directions, self.cuts, self.spread = np.zeros((trees, inner, sample.shape[1]), np.float32), np.zeros((trees, inner), np.float32), np.zeros((trees, inner), np.float32)
        for t in range(trees):
            points = {0: np.arange(len(sample))}
            for node in range(inner):
                own = points.pop(node)
                if len(own) >= 8:
                    for _ in range(3):
                        a, b = rng.choice(own, 2, replace=False)
                        if (d := sample[a] - sample[b]).any():
                            break
                else:
                    d = np.zeros(sample.shape[1], np.float32)
                if not d.any():
                    d = rng.standard_normal(sample.shape[1]).astype(np.float32)
                d = d / np.linalg.norm(d)
                at = sample[own] @ d
                middle = np.float32(np.median(at)) if len(own) else np.float32(0)
                self.directions[t, node], self.cuts[t, node] = d, middle
                right = at > middle
                points[2 * node + 1], points[2 * node + 2] = (own[~right], own[right]) if len(own) >= 8 else (own, own)
            self.spread[t] = np.maximum((sample[:2048] @ self.directions[t].T).std(axis=0), 1e-3) if inner else 0
        self.spread *= math.sqrt(1 - self.cosine**2)

    def centres(self, sample: np.ndarray) -> np.ndarray:
        """A unit vector for each leaf of the first tree: the mean direction of the sample in it, of all of it where that is none."""
        sums, leaf = np.zeros((1 << self.levels, sample.shape[1])), self.leaves(sample)[:, 0]
        np.add.at(sums, leaf, sample)
        for rest in (sample.sum(axis=0, dtype=np.float64), np.eye(1, sample.shape[1])[0]):
            sums[np.sqrt((sums * sums).sum(axis=1)) < 1e-3] = rest
        return sums / np.sqrt((sums * sums).sum(axis=1, keepdims=True))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x in each tree, numbered over all trees."""
        out = np.empty((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.levels):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.directions[t, node]) > self.cuts[t, node])
            out[:, t] = node - ((1 << self.levels) - 1) + (t << self.levels)
        return out

    def search(self, q: np.ndarray, sure: float = SURE, most: int | None = None) -> list[int]:
        """The leaves of all trees that q comes to until it is sure to have met a neighbour, `most` at most."""
        inner = (1 << self.levels) - 1
        right = _below((self.cosine * (self.directions @ q) - self.cuts).astype(np.float64) / self.spread) if inner else np.zeros((self.trees, 0))
        costs = np.stack([-np.log(1 - right), -np.log(right)], axis=2).tolist()  # of going left and right at each node
        queue, out, missed = [(0.0, t, 0) for t in range(self.trees)], [], [1.0] * self.trees
        while queue and math.prod(missed) > 1 - sure and (most is None or len(out) < most):
            cost, t, node = heapq.heappop(queue)
            while node < inner:
                left, other = costs[t][node]
                near, far = (1, other) if left <= other else (2, left)
                heapq.heappush(queue, (cost + far, t, 2 * node + 3 - near))
                cost, node = cost + min(left, other), 2 * node + near
            missed[t] -= math.exp(-cost)
            out.append(node - inner + (t << self.levels))
        return out


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def possible(cosines: np.ndarray, widest: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which leaves can hold a vector as near to a query as `least`: from cosines (query, leaf) with the centres and the least cosine of each leaf's vectors with its centre (above 1: none)."""
    between, within = np.arccos(np.clip(cosines, -1, 1)), np.arccos(np.clip(widest, -1, 1))
    return (np.cos(np.maximum(between - within, 0)) >= least[:, None] - SLACK) & (widest <= 1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(sound)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, trees: int = TREES, sure: float = SURE, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors found nearest to each vector whose vec_id is divisible by `every`, by cosine."""
    spark = vectors.sparkSession
    prepare(spark)
    found = usable(vectors)
    sizes = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["n"]
    found = found.where(F.size("v") == dim)
    copies = Window.partitionBy("v").orderBy("vec_id")
    kept = found.distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    picked = found.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    most = int(math.log2(max(1, FOREST // (4 * trees * dim))))
    levels = min(most, max(0, math.ceil(math.log2(max(1, sizes["count"]) / leaf))))
    page = min(PAGE, levels)
    fitted = _unit(picked["v"].combine_chunks(), dim).astype(np.float32)
    trees_ = Forest(fitted, levels, trees, k, sizes["count"])
    forest, centres = spark.sparkContext.broadcast(trees_), spark.sparkContext.broadcast(trees_.centres(fitted))
    kind = found.schema["v"].dataType.simpleString()

    def index(batches):
        for batch in batches:
            x = _unit(batch["v"], dim)
            found = forest.value.leaves(x.astype(np.float32))
            within = np.einsum("ij,ij->i", x, centres.value[found[:, 0]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * trees), pa.array(found.reshape(-1))), pa.array(within)], names=["vec_id", "v", "leaves", "within"])

    def look(batches):
        for batch in batches:
            rows = []
            for q in _unit(batch["q"], dim).astype(np.float32):
                masks: dict[int, int] = {}
                for x in forest.value.search(q, sure, FIRST):
                    masks[x >> page] = masks.get(x >> page, 0) | 1 << (x & (1 << page) - 1)
                rows.append([{"page": p, "mask": m} for p, m in masks.items()])
            yield pa.RecordBatch.from_arrays([batch["query_id"], batch["q"], pa.array(rows, _PAGES)], names=["query_id", "q", "pages"])

    indexed = cut(kept.mapInArrow(index, f"vec_id long, v {kind}, leaves array<int>, within double"))
    placed = indexed.select("vec_id", "v", F.explode("leaves").alias("leaf")).select(F.shiftright("leaf", page).alias("page"), F.col("leaf").bitwiseAND((1 << page) - 1).alias("slot"), "vec_id", "v")
    # the pages of all trees, whose number FOREST bounds
    blocks = placed.groupBy("page").count().select("page", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    asked = found.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct().repartition(sizes["count"] // every // LOOKED_UP + 1)

    def compared(queries: DataFrame) -> DataFrame:
        """query_id, ids, scores: the k best of each block of the pages that queries (query_id, q, pages) go to."""
        queries = cut(queries).select("query_id", "q", F.inline("pages"))
        parts = queries.groupBy("page").count().select("page", F.ceil(F.col("count") / block).cast("int").alias("parts"))
        dealt = F.broadcast(blocks.join(F.broadcast(parts), "page"))
        left = placed.join(dealt, "page").select("page", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "slot", "vec_id", "v")
        right = queries.join(dealt, "page").select("page", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"), "mask", "query_id", "q")
        key = ["page", "block", "part"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "query_id long, ids array<long>, scores array<double>")

    def compare(key, left, right):
        """The k best of a page for each of its queries, one row a query."""
        out = []
        if left.num_rows and right.num_rows:
            slots, masks = left["slot"].to_numpy(), right["mask"].to_numpy()
            order = np.argsort(slots, kind="stable")
            ends = np.searchsorted(slots[order], np.arange((1 << page) + 1))
            ids, queries = left["vec_id"].to_numpy()[order], right["query_id"].to_numpy()
            x, q = (t[c].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim) for t, c in ((left, "v"), (right, "q")))
            x = x[order]
            nx, nq = (np.sqrt((a * a).sum(axis=1)) for a in (x, q))
            ux, uq = x / nx[:, None], q / nq[:, None]
            taken = min(len(ids), k * int(np.unique(ids, return_counts=True)[1].max()))  # the k best ids are among so many rows
            for at in range(0, len(q), 256):
                mask, own = masks[at : at + 256], queries[at : at + 256]
                s = np.full((len(own), len(x)), -np.inf)
                for slot in np.flatnonzero(np.diff(ends)):
                    if len(a := np.flatnonzero(mask >> slot & 1)):
                        s[a, ends[slot] : ends[slot + 1]] = uq[at + a] @ ux[ends[slot] : ends[slot + 1]].T
                s[own[:, None] == ids] = -np.inf
                least = np.partition(s, -taken, axis=1)[:, -taken]
                i, j = np.nonzero((s >= least[:, None] - NEAR) & (s > -np.inf))
                exact = np.einsum("ij,ij->i", q[at + i], x[j]) / (nq[at + i] * nx[j])
                starts = np.searchsorted(i, np.arange(len(own) + 1))
                for r in np.flatnonzero(np.diff(starts)):
                    near = slice(starts[r], starts[r + 1])
                    out.append((own[r], *_ranked(ids[j[near]], exact[near], k)))
        query, best, scores = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(query, pa.int64()), "ids": pa.array(best, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))})

    def rank(batches):
        for batch in batches:
            rows = [(query, *_ranked(*(np.concatenate([np.array(x) for x in p]) for p in parts), k)) for query, *parts in zip(*(batch[c].to_pylist() for c in ("query_id", "ids", "scores")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())))], names=["query_id", "ids", "scores"])

    def best(pairs: DataFrame) -> DataFrame:
        # k for each block of the pages that a query comes to
        return pairs.groupBy("query_id").agg(F.collect_list("ids").alias("ids"), F.collect_list("scores").alias("scores")).mapInArrow(rank, "query_id long, ids array<long>, scores array<double>")

    first = cut(best(compared(asked.mapInArrow(look, f"query_id long, q {kind}, {_PAGES_SQL}"))))
    # one number for each leaf of a tree, whose number FOREST bounds
    widest = np.full(1 << levels, 2.0)
    for r in indexed.groupBy(F.col("leaves")[0].alias("leaf")).agg(F.min("within").alias("within")).collect():
        widest[r["leaf"]] = min(1.0, r["within"])
    bounds, slots = spark.sparkContext.broadcast(widest), np.int64(1) << np.arange(1 << page)

    def check(batches):
        for batch in batches:
            least = batch["least"].to_numpy(zero_copy_only=False)
            masks = possible(_unit(batch["q"], dim) @ centres.value.T, bounds.value, least).reshape(len(least), -1, 1 << page) @ slots
            rows = [[{"page": p, "mask": m[p]} for p in np.flatnonzero(m)] for m in masks]
            yield pa.RecordBatch.from_arrays([batch["query_id"], batch["q"], pa.array(rows, _PAGES)], names=["query_id", "q", "pages"])

    known = first.select("query_id", F.when(F.size("scores") >= k, F.element_at("scores", -1)).otherwise(-2.0).alias("least"))
    checked = compared(asked.join(known, "query_id", "left").select("query_id", "q", F.coalesce("least", F.lit(-2.0)).alias("least")).mapInArrow(check, f"query_id long, q {kind}, {_PAGES_SQL}"))
    return best(first.unionByName(checked)).select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def _ranked(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, each id once, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
    return ids[order], scores[order]
