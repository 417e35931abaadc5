"""Contents of files in blocks: each file is read once, kept under its hash, verified and read by range, whatever its size.

A block is a row of at most BLOCK bytes with the place of its first byte; blocks are small, as Spark's readers hold some thousand rows at a time. The hash of a file is carried over its blocks in order while they are read, so a task
holds one block at a time; the file's last row bears the hash.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import percent_decode
from ..sources.manifest import tasks

#: Bytes of a block, and of the blocks that leave a task together.
BLOCK, BATCH = 32 << 10, 4 << 20
_READ = pa.schema([("rel_path", pa.string()), ("encoded", pa.bool_()), ("at", pa.int64()), ("content", pa.binary()), ("sha256", pa.string()), ("size", pa.int64()), ("error", pa.string())])


def read(files: DataFrame, root: str, block: int = BLOCK) -> DataFrame:
    """rel_path, encoded, at, content, sha256, size, error of the blocks of files (rel_path, encoded) below a root; hash and size in a file's last row. A file that cannot be read to its end has a row with the error and none with a hash."""
    top = os.fsencode(root)

    def blocks(rel: str, encoded: bool) -> Iterator[tuple]:
        h, at = hashlib.sha256(), 0
        try:
            with open(os.path.join(top, percent_decode(rel, encoded)), "rb") as f:
                part = f.read(block)
                while True:
                    h.update(part)
                    following = f.read(block) if len(part) == block else b""
                    last = not following
                    yield rel, encoded, at, part, h.hexdigest() if last else None, at + len(part) if last else None, None
                    if last:
                        return
                    at, part = at + len(part), following
        except OSError as e:
            yield rel, encoded, None, None, None, None, e.strerror or str(e)

    def taken(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for rel, encoded in zip(b["rel_path"].to_pylist(), b["encoded"].to_pylist(), strict=True):
                for row in blocks(rel, encoded):
                    rows.append(row)
                    size += len(row[3] or b"") + 200
                    if size > BATCH:
                        yield taken(rows)
                        rows, size = [], 0
        if rows:
            yield taken(rows)

    wanted = files.select("rel_path", "encoded")
    return wanted.repartition(tasks(wanted.count(), 16, 1024), "rel_path").mapInArrow(run, "rel_path string, encoded boolean, at long, content binary, sha256 string, size long, error string")


def split(contents: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks (sha256, at, content) of contents (sha256, content) that are at hand as a whole."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.length("content") - 1, F.lit(0)).cast("long"), F.lit(block).cast("long")))
    return contents.select("sha256", "content", at.alias("at")).select("sha256", "at", F.substring(F.col("content"), (F.col("at") + 1).cast("int"), F.lit(block)).alias("content"))


def states(held: DataFrame) -> DataFrame:
    """sha256, good: whether the blocks kept under a hash (sha256, at, content) are what it says. Contents of one block are hashed where they lie; those of several are dealt by hash and hashed block by block in order. Blocks that are kept twice are damage."""
    several = held.groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1").select("sha256")
    one = held.join(several, "sha256", "left_anti").select("sha256", ((F.sha2("content", 256) == F.col("sha256")) & (F.coalesce("at", F.lit(0)) == 0)).alias("good"))

    def hashed(batches):
        name, h, at, good = None, hashlib.sha256(), 0, True

        def result():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([good and h.hexdigest() == name])], names=["sha256", "good"])

        for b in batches:
            for sha, start, content in zip(b["sha256"].to_pylist(), b["at"].to_pylist(), b["content"], strict=True):
                if sha != name:
                    if name is not None:
                        yield result()
                    name, h, at, good = sha, hashlib.sha256(), 0, True
                data = content.as_buffer()
                good = good and start == at
                h.update(data)
                at += data.size
        if name is not None:
            yield result()

    more = held.join(several, "sha256", "left_semi").select("sha256", "at", "content").repartition("sha256").sortWithinPartitions("sha256", "at")
    return one.unionByName(more.mapInArrow(hashed, "sha256 string, good boolean"))


def between(held: DataFrame, sha256: str, offset: int, length: int) -> DataFrame:
    """sha256, bytes: a range of a content (one row; none where it is not held). Only the first block and those that it touches are read."""
    at = F.coalesce("at", F.lit(0))
    touched = held.where(F.col("sha256") == sha256).where((at < offset + length) & (at + F.length("content") > offset) | (at == 0))
    start = F.greatest(F.lit(offset) - at, F.lit(0))
    piece = F.when(at + F.length("content") <= offset, F.lit(b"")).otherwise(F.substring(F.col("content"), (start + 1).cast("int"), F.greatest(F.lit(offset + length) - at - start, F.lit(0)).cast("int")))
    parts = F.array_sort(F.collect_list(F.struct(at.alias("at"), piece.alias("piece"))))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, p: F.concat(whole, p["piece"]))
    return touched.groupBy("sha256").agg(joined.alias("bytes"))


def slice_of(file: DataFrame, root: str, offset: int, length: int) -> DataFrame:
    """bytes: a range of a file (rel_path, encoded) below a root, read by a task; no row where it cannot be read."""
    top = os.fsencode(root)

    def run(batches):
        for b in batches:
            for rel, encoded in zip(b["rel_path"].to_pylist(), b["encoded"].to_pylist(), strict=True):
                try:
                    with open(os.path.join(top, percent_decode(rel, bool(encoded))), "rb") as f:
                        f.seek(offset)
                        yield pa.RecordBatch.from_arrays([pa.array([f.read(length)], pa.binary())], names=["bytes"])
                except OSError:
                    continue

    return file.mapInArrow(run, "bytes binary")
