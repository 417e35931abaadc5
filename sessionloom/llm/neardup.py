"""Operator 8: near duplicates by circulant MinHash, banding and exact verification.

A document's set are its distinct shingles of SHINGLE words (A-Z folded); with fewer words, the whole
sequence is one. Every shingle becomes a place in a universe of 2^32. A first permutation scatters
the places; coordinate k of the signature is the least value of a second permutation, shifted
circularly by k: two permutations make all coordinates. BANDS bands of ROWS coordinates give the
candidates; a pair of similarity 0.85 misses all bands with probability 8e-6.

Documents with equal sets form a class, found by a 128-bit sum over the set; only the class goes on,
under a number of its own. In each bucket of a band, members are first paired with the bucket's least
class and verified on full sets: a bucket of m alike documents costs m pairs and not m * m. A class that
heads more than a thousandth of all pairs is salted, its set sent once to each salt. Then, in what is
still unconnected, members from different components of a bucket are looked at too, so that every candidate
pair is either decided or already connected, and none is dropped. Buckets of up to BUCKET members do that pair
by pair. In larger ones, whose members are alike only in what all of them have, it is done through the rarest
shingles of each set: of two sets so similar, the (100 - s) % rarest and one more always share one
(prefix filtering, which loses nothing whatever the order of rarity, so rarity is counted in a table of fixed size).
Pairs whose sizes or parity sketches prove that they differ too much are never made: that is a condition
of the join itself (a sketch holds the parity of 512 counters; two sets differ by at least as many
shingles as their sketches by bits). All other pairs are verified on full sets.

Nulls: a row without text or words is empty and linked with nothing; a row without doc_id is linked
with nothing and has no component (kept is true). Rows that share a doc_id are judged each by its own text,
and not linked for their id; their order does not matter. Ties go to the
smaller doc_id. An empty table gives an empty one; of further columns none is read.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, components, cut, encoded, factors, few_files, groups_for, hashed, mix, prepare, text_bytes, windows

SHINGLE, ROWS, BANDS = 5, 4, 16

#: Links need 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85

SKETCH = 512

#: Members of a bucket that are compared pair by pair, at most, and pairs of one class that one task takes in any case.
BUCKET, HUB = 256, 4096

#: Slots in which the rarity of shingles is counted.
SLOTS = 20

_BY = [factors(n, 80 + n) for n in range(SHINGLE + 1)]
_KEY, _BAND = factors(2, 91), factors(ROWS + 1, 92)


def _sets(texts: list[bytes], shingle: int):
    """Blocks (i, sizes, members): texts i, i+1, ... have sets of these sizes; members are ordered within each set."""
    for i, counts, h in hashed(texts, fold=True):
        sizes, members = np.zeros(len(counts), np.int64), []
        ends = np.cumsum(counts)
        for k, (b, e) in enumerate(zip(ends - counts, ends, strict=True)):
            if e > b:
                n = min(shingle, e - b)
                x = np.unique(windows(h[b:e], np.arange(e - b - n + 1), _BY[n] if n <= SHINGLE else factors(n, 80 + n)))
                sizes[k] = len(x)
                members.append(x)
        yield i, sizes, np.concatenate([np.zeros(0, U64), *members])


def _scatter(x: np.ndarray, a: int, b: int, s: int, t: int, u: int) -> np.ndarray:
    """A permutation of 2^32 places."""
    x = x ^ (x >> np.uint32(s))
    x *= np.uint32(a)
    x ^= x >> np.uint32(t)
    x *= np.uint32(b)
    x ^= x >> np.uint32(u)
    return x


def signatures(members: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """k circulant MinHash coordinates of each set of members; sets begin at starts and are not empty."""
    out = np.empty((len(starts), k), np.uint32)
    place = _scatter((members >> U64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B, 16, 15, 16)
    for c in range(k):
        out[:, c] = np.minimum.reduceat(_scatter(place - np.uint32(c), 0x85EBCA6B, 0xC2B2AE35, 16, 13, 16), starts)
    return out


def profile(docs: DataFrame, shingle: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (equal for equal sets), bands (one key for each band), sketch of every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), [encoded(x) for x in batch["text"].to_pylist()]
            for i, sizes, members in _sets(texts, shingle):
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                n = len(full)
                keys, band, sketch = np.zeros((2, len(sizes)), U64), np.zeros((n, bands), U64), np.zeros((n, SKETCH), np.uint8)
                if n:
                    for k in range(2):
                        keys[k, full] = np.add.reduceat(mix(members * _KEY[k]), starts)
                    signed = signatures(members, starts, rows * bands).astype(U64).reshape(n, bands, rows)
                    band = mix((signed * _BAND[:rows]).sum(axis=2, dtype=U64) + np.arange(bands, dtype=U64) * _BAND[rows])
                    of = np.repeat(np.arange(n), sizes[full]) * SKETCH + (members & U64(SKETCH - 1)).astype(np.int64)
                    sketch = (np.bincount(of, minlength=n * SKETCH) & 1).astype(np.uint8)
                bits = np.packbits(sketch.reshape(n, SKETCH), axis=1).view(np.int64).reshape(n, -1)
                at = np.full(len(sizes), -1)
                at[full] = np.arange(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i : i + len(sizes)], pa.int64()), pa.array(sizes), *(pa.array(k.view(np.int64)) for k in keys),
                        *(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((at >= 0) * v.shape[1])]).astype(np.int32)), pa.array(v.reshape(-1).view(np.int64))) for v in (band, bits)),
                    ], schema=schema,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>")


def _members(docs: DataFrame, shingle: int) -> DataFrame:
    """id, members (packed set) of docs (id, k1, k2, text): the rows whose sets have these keys."""

    def run(batches):
        for batch in batches:
            ids, texts = batch["id"].to_pylist(), [encoded(x) for x in batch["text"].to_pylist()]
            wanted = [batch[k].to_numpy().view(np.uint64) for k in ("k1", "k2")]
            for i, sizes, members in _sets(texts, shingle):
                out, ends = ([], []), np.cumsum(sizes)
                for k, (n, e) in enumerate(zip(sizes, ends, strict=True)):
                    own = members[e - n : e]
                    if all(mix(own * f).sum(dtype=U64) == w[i + k] for f, w in zip(_KEY, wanted, strict=True)):
                        out[0].append(ids[i + k])
                        out[1].append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["id", "members"])

    return docs.mapInArrow(run, "id long, members binary")


def _facts(classes: DataFrame, rep: str, n: str, s: str) -> DataFrame:
    """Size and sketch of each class, under other names; the sketch as SKETCH / 64 columns."""
    return classes.select(F.col("id").alias(rep), F.col("n_shingles").alias(n), *(F.col("sketch")[k].alias(f"{s}{k}") for k in range(SKETCH // 64)))


def _may_be_alike(similarity: int, n: str = "n", m: str = "m", s: str = "s", t: str = "t") -> Column:
    """False only where sizes or sketches prove that two sets are too different: similar sets differ in at most (100 - s) / (100 + s) of n + m shingles."""
    apart = functools.reduce(operator.add, (F.bit_count(F.col(f"{s}{k}").bitwiseXOR(F.col(f"{t}{k}"))) for k in range(SKETCH // 64)))
    return (100 * F.least(n, m) >= similarity * F.greatest(n, m)) & ((100 + similarity) * apart <= (100 - similarity) * (F.col(n) + F.col(m)))


def _with_first(pairs: DataFrame, facts: DataFrame, hub: int) -> DataFrame:
    """pairs (a, b) joined with facts (a, ...) on a. A class with more than a thousandth of all pairs is dealt over salts."""
    most = max(hub, pairs.count() // 1000)
    hubs = cut(pairs.groupBy("a").count().where(F.col("count") > most).select("a", F.ceil(F.col("count") / most).cast("int").alias("salts")), 1)
    if hubs.isEmpty():
        return pairs.join(facts, "a")
    hubs = F.broadcast(hubs)  # fewer than 1000 rows, as each stands for more than a thousandth
    dealt = pairs.join(hubs, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), "salts").cast("int"), F.lit(0))).drop("salts")
    copies = facts.join(hubs, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(copies, ["a", "salt"]).drop("salt")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: int, hub: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    full = _with_first(pairs, sets.select(F.col("id").alias("a"), F.col("members").alias("x")), hub).join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _rarest(sets: DataFrame, similarity: int) -> DataFrame:
    """sets (members, ...) without members and with shingle: a row for each of the rarest shingles of a set, so many that two similar sets have one in common."""

    def count(batches):
        seen = np.zeros(1 << SLOTS, np.int64)
        for batch in batches:
            for x in batch["members"].to_pylist():
                np.add.at(seen, (np.frombuffer(x, U64) >> U64(64 - SLOTS)).astype(np.int64), 1)
        slots = np.flatnonzero(seen)
        for at in range(0, len(slots), 65536):
            part = slots[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[part])], names=["slot", "n"])

    found = sets.select("members").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2^SLOTS rows
    times = np.zeros(1 << SLOTS, np.int64)
    times[found["slot"].to_numpy()] = found["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(times)
    rest = [c for c in sets.columns if c != "members"]

    def pick(batches):
        for batch in batches:
            shingles, sizes = [np.zeros(0, np.int64)], []
            for x in batch["members"].to_pylist():
                x = np.frombuffer(x, U64)
                size = len(x) + similarity * -len(x) // 100 + 1  # n - ceil(s * n) + 1
                first = x[np.lexsort((x, shared.value[(x >> U64(64 - SLOTS)).astype(np.int64)]))[:size]]
                sizes.append(len(first))
                shingles.append(first.view(np.int64))
            rows = batch.select(rest).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(shingles))], names=[*rest, "shingle"])

    return sets.mapInArrow(pick, T.StructType([*sets.select(rest).schema.fields, T.StructField("shingle", T.LongType())]))


def _across(placed: DataFrame, meet: list[str], similarity: int) -> DataFrame:
    """a, b, p, q: pairs of placed (meet, id, part, n, sketch) from different parts that meet and may be alike. What proves them unlike is part of the join, so such pairs are never made."""
    k = range(SKETCH // 64)
    other = placed.select(*meet, F.col("id").alias("b"), F.col("part").alias("q"), F.col("n").alias("m"), *(F.col(f"s{x}").alias(f"t{x}") for x in k))
    left, right = placed.alias("l"), other.alias("r")
    on = functools.reduce(operator.and_, (F.col(f"l.{c}") == F.col(f"r.{c}") for c in meet))
    return left.join(right, on & (F.col("id") < F.col("b")) & (F.col("part") != F.col("q")) & _may_be_alike(similarity)).select(F.col("id").alias("a"), "b", F.col("part").alias("p"), "q")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, shingle: int = SHINGLE, rows: int = ROWS, bands: int = BANDS, bucket: int = BUCKET, hub: int = HUB) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    total = text_bytes(docs)
    files, many = groups_for(total, 256 << 20, 4), groups_for(total, 32 << 20, 24)
    every = cut(profile(docs, shingle, rows, bands), many)
    classes = every.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), 2 * files)
    banded = classes.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "key", "a")
    members = cut(banded.join(buckets, ["band", "key"]), 2 * files)
    wanted = members.select("id").distinct().join(classes.select("id", F.col("rep").alias("doc_id"), "k1", "k2"), "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = cut(_members(texts.join(wanted, "doc_id").select("id", "k1", "k2", "text"), shingle), many)
    if not every.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "k1", "k2").count().where("count > 1").isEmpty():  # rows of equal id and set
        sets = cut(sets.dropDuplicates(["id"]), many)
    stars = members.where("id > a").select("a", F.col("id").alias("b")).distinct()
    stars = cut(stars, files)
    near = _with_first(stars, _facts(classes, "a", "n", "s"), hub).join(_facts(classes, "b", "m", "t"), "b").where(_may_be_alike(similarity)).select("a", "b")
    links = cut(_alike(cut(near, files), sets, similarity, hub), files)
    parts = components(links, files)
    labelled = cut(members.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("part")), 2 * files)
    unsettled = labelled.groupBy("band", "key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("band", "key", "size")
    left = labelled.join(unsettled, ["band", "key"])
    across = _across(left.where(F.col("size") <= bucket).drop("size").join(_facts(classes, "id", "n", "s"), "id"), ["band", "key"], similarity)
    large = cut(left.where(F.col("size") > bucket).select("id", "part").distinct(), files)
    if not large.isEmpty():
        placed = cut(sets.join(large.join(_facts(classes, "id", "n", "s"), "id"), "id"), many)
        across = across.unionByName(_across(_rarest(placed, similarity), ["shingle"], similarity))
    across = cut(across.distinct().join(stars, ["a", "b"], "left_anti"), files)
    more = cut(_alike(across.select("a", "b"), sets, similarity, hub).join(across, ["a", "b"]).select(F.col("p").alias("a"), F.col("q").alias("b")), files)
    if not more.isEmpty():  # links between the components found so far
        joined = components(more, files).select(F.col("node").alias("component"), F.col("component").alias("into"))
        parts = parts.unionByName(joined.select(F.col("component").alias("node"), "component").join(parts.select("node"), "node", "left_anti"))
        parts = parts.join(joined, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    parts = cut(parts.select(F.col("node").alias("id"), F.col("component").alias("part")).join(classes.select("id", "rep"), "id"), files)
    least = parts.groupBy("part").agg(F.min("rep").alias("component"))
    whole = classes.select("k1", "k2", "n_shingles", "id", "rep").join(parts.join(least, "part").select("id", "component"), "id", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    found = every.select("doc_id", "n_shingles", "k1", "k2").join(whole, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return few_files(found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")), total)
