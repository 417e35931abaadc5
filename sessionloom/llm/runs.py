"""Operator 12: periodic runs of words, by tiles for each octave of periods, boundary Z-functions and stitched intervals.

A run is a stretch of words with smallest period q, at least max(LEAST, TIMES * q) long, that no neighbour extends. For the octave of
periods m <= q < 2m a document has a boundary every m words (2 in the first octave). A run that long has a boundary b such that it
holds the q words before b and the 2m words after it. So the windows at b and at some b - q are equal; a sieve of window hashes, which
can err only by letting more through, leaves the boundaries where that may be so. Around these, tiles of some 3m words to either side are cut out, neighbouring
ones joined up to STRIP words, and dealt over the tasks of the cluster: a very long document is many rows, and no task needs more than one of them.

A tile is solved alone. The Z-function of the words from b on, run over the words before, gives for every q how far the words go on with period q; that of the
reversed words before b gives how far they do so backwards. Of periods with the same stretch the smallest is its true one. What fits or
touches the tile's edge is an interval fragment. Fragments are dealt by document and period; those that overlap by a period are one interval, and intervals that are long enough are runs.
Words are compared as numbers of their own in each document, so nothing rests on hashes but the sieve, and the name of a row: 128 bits of doc_id and text.

Words are runs of bytes without 0x20 and 0x09 to 0x0D. A null text, an empty one and one of white space have no words and no runs. Rows whose
doc_id has a checksum divisible by 10 are planted with a repetition first (see `planted`); a null doc_id never is. Rows of equal doc_id and text are
solved once and give equal results. An empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, encoded, mix, prepare

#: Words that a run has at least, whatever its period, and periods.
LEAST, TIMES = 6, 4

#: Words of neighbouring tiles that are joined; bytes of rows that leave Python together.
STRIP, BATCH = 8192, 4 << 20

_TILE = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("octave", pa.int32()), ("at", pa.int64()), ("codes", pa.binary()), ("bounds", pa.binary())])
_RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, with those from some place on repeated periodically where the checksum of doc_id says so."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _reach(m: int) -> int:
    """Words to either side of a boundary that a tile holds."""
    return 3 * m + 4


def sieved(codes: np.ndarray):
    """(m, boundaries) of each octave: where the words after a boundary also stand m to 2m - 1 words before it."""
    h, wide, m, n = codes.astype(U64), 1, 1, len(codes)
    while TIMES * m <= n and n >= LEAST:
        while wide < max(2 * m, 4):
            h = mix(h[: n - 2 * wide + 1] * U64(0x9E3779B97F4A7C15) + h[wide:])
            wide *= 2
            if len(h) < 1:
                return
        if m == 1:
            right = h[2::2]
            found = 2 + 2 * np.flatnonzero(h[1::2][: len(right)] == right)
        else:
            right = h[2 * m :: m]
            found = (2 + np.flatnonzero((h[1 : 1 + len(right) * m].reshape(len(right), m) == right[:, None]).any(axis=1))) * m
        if len(found):
            yield m, found
        m *= 2


def strips(codes: np.ndarray):
    """(octave, first word, words, boundaries from the first word) of the tiles of a document, neighbouring ones joined."""
    for m, found in sieved(codes):
        near = _reach(m)
        i = 0
        while i < len(found):
            j = i + 1
            while j < len(found) and found[j] - found[j - 1] <= 2 * near and found[j] - found[i] <= STRIP:
                j += 1
            first = max(0, int(found[i]) - near)
            yield m.bit_length() - 1, first, codes[first : int(found[j - 1]) + near], found[i:j] - first
            i = j


def _z(s: list, upto: int) -> list[int]:
    """For each of the first places of s, how many elements from there on are those at the beginning of s."""
    z, left, right, n = [0] * upto, 0, 0, len(s)
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _further(a: np.ndarray, at: int, q: int, step: int) -> int:
    """How many words from a place on, to the right (step 1) or to the left (-1), are equal to those q words before (to the left: behind)."""
    done, size = 0, 64
    while True:
        here = a[at + done : at + done + size] if step > 0 else a[max(0, at - done - size + 1) : at - done + 1][::-1]
        there = a[at - q + done : at - q + done + size] if step > 0 else a[max(0, at + q - done - size + 1) : at + q - done + 1][::-1]
        k = min(len(here), len(there))
        differ = np.flatnonzero(here[:k] != there[:k])
        if len(differ) or k < size:
            return done + (int(differ[0]) if len(differ) else k)
        done, size = done + size, 2 * size


def solved(codes: np.ndarray, bounds: list[int], m: int, at: int, n: int) -> set[tuple[int, int, int]]:
    """(period, start, end) of the fragments of a strip that begins with word `at` of n, for the periods of an octave."""
    size, near, out, seen_to = len(codes), _reach(m), set(), (0, 0)
    for b in bounds:
        if seen_to[0] <= b - 2 * m and b + max(2 * m, 4) <= seen_to[1]:
            continue  # well inside a stretch of such a period: whatever run holds this boundary is that one
        left, right = max(0, b - near), min(size, b + near)
        most = min(2 * m - 1, b - left)
        before, after = codes[left:b].tolist(), codes[b:right].tolist()
        back = _z(before[::-1], most + 1) if len(before) > most else [*_z(before[::-1], len(before)), 0]
        forth = _z([*after, -1, *before[len(before) - most :], *after], len(after) + 1 + most)
        seen = set()
        for q in range(1, most + 1):
            s, e = b - q - back[q], b + forth[len(after) + 1 + most - q]
            if e - s < 2 * q or (s, e) in seen:
                continue
            seen.add((s, e))
            if e == right < size:
                e += _further(codes, e, q, 1)
            if s == left > 0:
                s -= _further(codes, s - 1, q, -1)
            if e > seen_to[1]:
                seen_to = (s, e)
            if q >= m and (e - s >= max(LEAST, TIMES * q) or s == 0 < at or e == size < n - at):
                out.add((q, at + s, at + e))
    return out


def _rows_of(doc_id: int | None, text: str | None):
    """A row of each strip of tiles of a document, and one of the document: with its words where it has tiles, else with their digest."""
    data = encoded(text)
    words = planted(doc_id, data.split())
    key = hashlib.blake2b(f"{doc_id} ".encode() + data, digest_size=16).digest()
    first: dict[bytes, int] = {}
    codes, some = np.array(list(map(first.setdefault, words, range(len(words)))), np.int32), False
    for octave, at, part, bounds in strips(codes):
        some = True
        yield key, None, len(words), None, octave, at, part.tobytes(), bounds.astype(np.int32).tobytes()
    whole = b" ".join(words)
    yield (key, doc_id, len(words), whole, None, None, None, None) if some else (key, doc_id, len(words), hashlib.sha256(whole).digest(), -1, None, None, None)


def _explode(batches):
    def taken():
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _TILE, strict=True)], schema=_TILE)

    rows, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for row in _rows_of(doc_id, text):
                rows.append(row)
                size += 100 + sum(len(x) for x in row if isinstance(x, bytes))
                if size > BATCH:
                    yield taken()
                    rows, size = [], 0
    if rows:
        yield taken()


def _solve(batches):
    for batch in batches:
        out = {"key": [], "period": [], "start": [], "end": []}
        for key, n, octave, at, codes, bounds in zip(*(batch[k].to_pylist() for k in ("key", "n", "octave", "at", "codes", "bounds")), strict=True):
            for q, s, e in sorted(solved(np.frombuffer(codes, np.int32), np.frombuffer(bounds, np.int32).tolist(), 1 << octave, at, n)):
                for k, x in zip(out, (key, q, s, e), strict=True):
                    out[k].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.binary()), *(pa.array(out[k], pa.int64()) for k in ("period", "start", "end"))], names=list(out))


def stitched(fragments: DataFrame) -> DataFrame:
    """(key, start, length, period) of the runs of fragments (key, period, start, end): those of one document and period that overlap by a period or more are parts of one."""
    before = "max(`end`) OVER (PARTITION BY key, period ORDER BY start, `end` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    parts = fragments.withColumn("new", F.expr(f"CAST(coalesce(start > {before} - period, true) AS int)"))
    parts = parts.withColumn("run", F.expr("sum(new) OVER (PARTITION BY key, period ORDER BY start, `end` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    whole = parts.groupBy("key", "period", "run").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    return whole.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period"))).select("key", "start", "length", "period")


def described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """What the result says of a document with the runs (start, length, period), in order."""
    dropped = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        dropped[s + q] += 1
        dropped[s + length] -= 1
    kept = [words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0)]
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _describe(batches):
    columns = [x.split() for x in _RESULT.split(", ")]
    for batch in batches:
        out = {k: [] for k, _ in columns}
        for doc_id, words, runs in zip(batch["doc_id"].to_pylist(), batch["words"].to_pylist(), batch["runs"].to_pylist(), strict=True):
            found = [(r["start"], r["length"], r["period"]) for r in runs or ()]
            for k, x in zip(out, (doc_id, *described(words.split(b" ") if words else [], found)), strict=True):
                out[k].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.string() if t == "string" else pa.int64()) for k, t in columns], names=list(out))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(docs.mapInArrow(_explode, "key binary, doc_id long, n long, words binary, octave int, at long, codes binary, bounds binary"))
    tiles = rows.where("codes is not null").dropDuplicates(["key", "octave", "at"])
    fragments = tiles.select("key", "n", "octave", "at", "codes", "bounds").mapInArrow(_solve, "key binary, period long, start long, end long")
    runs = stitched(fragments).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    whole = rows.where("codes is null and octave is null").select("key", "doc_id", "words").join(runs, "key", "left")
    none = F.lit(None).cast("long")
    plain = rows.where("codes is null and octave is not null").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), *(none.alias(k) for k in ("start", "length", "period", "exponent_milli")), F.sha2(F.lit(""), 256).alias("runs_sha256"), F.lower(F.hex("words")).alias("collapsed_sha256"),
    )
    return whole.select("doc_id", "words", "runs").mapInArrow(_describe, _RESULT).unionByName(plain)
