"""What the operators of this subpackage share: session settings, checkpoints, hashing of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut

#: Rows in an Arrow batch. Batches of whole texts stay small even where texts are long.
ARROW_ROWS = 256

U64 = np.uint64


def prepare(spark: SparkSession) -> None:
    """Bounds the batches that go to Python and makes sure that checkpoint() has a folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    checkpoint_dir(spark)


def few_files(df: DataFrame, total: int) -> DataFrame:
    """df, which has short rows, dealt into few partitions: one for each 256 MB of the texts that it comes from."""
    return df.repartition(groups_for(total, 256 << 20, 4))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; one pass over one column."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def groups_for(total: int, each: int, least: int = 96) -> int:
    """How many groups of about `each` bytes `total` bytes make; `each` grows with the input up to 16 times, so that groups and tasks stay balanced."""
    each = min(16 * each, max(each, total // 16384))
    return int(max(least, -(-total // each)))


# --- words as 64-bit hashes, a whole buffer at a time -------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS = np.cumprod(np.full(4096, U64(0x9E3779B97F4A7C15)), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Bytes that are no letters or digits; bytes above 0x7F belong to letters.
_MARKS = np.ones(256, bool)
_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(data: bytes, fold: bool = False, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of data, as bytes.split() finds them: runs without 0x20 and 0x09 to 0x0D. fold: A-Z count as a-z. marks: punctuation parts words as well."""
    global _POWERS
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~(_MARKS if marks else _SPACE)[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, U64)
    size = ends - starts
    if (most := int(size.max())) > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * most, U64(0x9E3779B97F4A7C15)), dtype=np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), size)  # of each byte within its word
    value = (_FOLDED if fold else _BYTE)[raw[inside[1:-1].view(bool)]]
    value *= _POWERS[place]
    return starts, ends, mix(np.add.reduceat(value, first) + size.astype(U64))


#: Bytes of text that are hashed at once.
BLOCK = 1 << 18
_SPACES = re.compile(rb"[\x20\x09-\x0d]")


def hashed(texts: list[bytes], fold: bool = False, marks: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (i, counts, hashes): texts i, i+1, ... have counts words each, with these hashes. A block holds about BLOCK bytes, and whole texts; a longer text is a block of its own, hashed bit by bit."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > BLOCK:
            parts, at = [], 0
            while at < len(texts[i]):
                gap = _SPACES.search(texts[i], at + BLOCK)
                end = gap.start() if gap else len(texts[i])
                parts.append(words(texts[i][at:end], fold, marks)[2])
                at = end
            h = np.concatenate(parts)
            yield i, np.array([len(h)]), h
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= BLOCK:
            size += len(texts[j]) + 1
            j += 1
        starts, _, h = words(b"\n".join(texts[i:j]), fold, marks)
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        yield i, np.diff(np.concatenate([[0], np.searchsorted(starts, ends)])), h
        i = j


def factors(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit factors."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)


def windows(hashes: np.ndarray, at: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Hash of the len(by) words that start at each position of at."""
    total = np.zeros(len(at), U64)
    for k, f in enumerate(by):
        total += hashes[at + k] * f
    return mix(total)


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


# --- connected components ------------------------------------------------------------------------


def components(edges: DataFrame, files: int = 4, rounds: int = 60) -> DataFrame:
    """(node, component) of each node of edges (a, b): component is the smallest node reachable. Large star and small star by turns until nothing changes; every round is a few shuffles of the edges, none goes to the driver, and hubs are met by partial aggregation and joins only."""
    e = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), files)
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        e = cut(small.distinct(), files)
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(roots.join(e.select(F.col("a").alias("node")).distinct(), "node", "left_anti").withColumn("component", F.col("node")))
