"""The manifest of a directory: every file and link with size, times and hash. Links are listed, not followed.

Directories are listed by tasks, breadth first: the directories of one depth are rows, dealt over the tasks, and what they hold is
written before the next depth begins. No list of names comes to the driver, only the number of directories of each depth. Contents are hashed by tasks, streaming.

A directory, a file or a link that cannot be read, or is gone before it is, becomes a row of kind `unreadable` with the error. A name that is no UTF-8 is
given as text with %XX for its odd bytes, and `encoded` is true. An empty directory gives no rows; sockets and devices are left out.
"""

from __future__ import annotations

import datetime
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import percent_decode, percent_encode
from ..session import cut

COLUMNS = "rel_path string, encoded boolean, kind string, size long, mtime string, ctime string, atime string, error string"
_SCHEMA = pa.schema([("raw", pa.binary()), ("rel_path", pa.string()), ("encoded", pa.bool_()), ("kind", pa.string()), ("size", pa.int64()), ("mtime", pa.string()), ("ctime", pa.string()), ("atime", pa.string()), ("error", pa.string())])

#: Directories that one task lists, and files that one task hashes, at least; beyond TASKS tasks each takes more, one after the other.
DIRECTORIES, FILES, TASKS = 64, 64, 256
#: Rows that leave a task together.
ROWS = 4096


def tasks(n: int, each: int, most: int = TASKS) -> int:
    """Tasks for n things, of which one task takes `each` at least."""
    return max(1, min(most, -(-n // each)))


def _stamp(seconds: float) -> str:
    at = datetime.datetime.fromtimestamp(seconds, datetime.UTC)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def _unreadable(raw: bytes, e: OSError) -> tuple:
    return raw, *percent_encode(raw), "unreadable", None, None, None, None, e.strerror or str(e)


def _entries(root: bytes, raw: bytes) -> Iterator[tuple]:
    """What a directory holds."""
    try:
        found = os.scandir(os.path.join(root, raw))
    except OSError as e:
        yield _unreadable(raw, e)
        return
    with found:
        for x in found:
            path = os.path.join(raw, x.name)
            try:
                stat = x.stat(follow_symlinks=False)
                kind = "symlink" if x.is_symlink() else "dir" if x.is_dir(follow_symlinks=False) else "file" if x.is_file(follow_symlinks=False) else None
            except OSError as e:
                yield _unreadable(path, e)
                continue
            if kind:
                yield path, *percent_encode(path), kind, 0 if kind == "dir" else stat.st_size, _stamp(stat.st_mtime), _stamp(stat.st_ctime), _stamp(stat.st_atime), None


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def listing(spark: SparkSession, root: str, depth: int | None = None) -> DataFrame:
    """COLUMNS of whatever is below a directory that all executors see, directories too, down to a depth."""
    top = os.fsencode(root)

    def listed(batches):
        yield from _batches((x for b in batches for raw in b["raw"].to_pylist() for x in _entries(top, raw)), _SCHEMA)

    found, n, level = spark.createDataFrame([], "raw binary, " + COLUMNS), 1, 0
    frontier = spark.createDataFrame([(bytearray(b""),)], "raw binary")
    while n and (depth is None or level < depth):
        here = cut(frontier.repartition(tasks(n, DIRECTORIES), "raw").mapInArrow(listed, "raw binary, " + COLUMNS))
        found, frontier, level = found.unionAll(here), here.where("kind = 'dir'").select("raw"), level + 1
        n = frontier.count()
    return found.drop("raw")


def hashed(rows: DataFrame, root: str, links: bool = True, chunk: int = 64 << 10) -> DataFrame:
    """The files, links and unreadable rows of a listing with the hash of their contents, of a link that of its target (where links is true)."""
    top = os.fsencode(root)
    schema = pa.schema([*_SCHEMA][1:] + [("sha256", pa.string())])

    def run(rel: str, encoded: bool, kind: str) -> str | None:
        path, h = os.path.join(top, percent_decode(rel, encoded)), hashlib.sha256()
        if kind == "symlink":
            return hashlib.sha256(os.readlink(path)).hexdigest() if links else None
        with open(path, "rb") as f:
            while part := f.read(chunk):
                h.update(part)
        return h.hexdigest()

    def each(batches):
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                r["sha256"] = None
                if r["kind"] != "unreadable":
                    try:
                        r["sha256"] = run(r["rel_path"], r["encoded"], r["kind"])
                    except OSError as e:
                        r |= {"kind": "unreadable", "error": e.strerror or str(e)}
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    wanted = rows.where("kind <> 'dir'")
    return wanted.repartition(tasks(wanted.count(), FILES), "rel_path").mapInArrow(each, COLUMNS + ", sha256 string")


def manifest(spark: SparkSession, root: str, links: bool = False) -> DataFrame:
    """The manifest of a directory that all executors see. links: with the hash of each link's target."""
    return hashed(listing(spark, root), root, links)


def stores(files: DataFrame, expected: dict[str, str]) -> DataFrame:
    """files with the store that each belongs to, by the longest expected prefix."""
    kinds = F.array(*(F.struct(F.lit(p).alias("prefix"), F.lit(k).alias("kind")) for k, p in sorted(expected.items(), key=lambda x: -len(x[1]))))
    return files.withColumn("store", F.try_element_at(F.filter(kinds, lambda x: F.startswith(F.col("rel_path"), x["prefix"])), F.lit(1))["kind"])


def sidecar(wanted: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """wanted (rel_path, sha256 as recorded) with the state of the file that it names: ok, missing, symlink, too_large, changed."""
    f = files.where("kind <> 'unreadable'").select("rel_path", "kind", "size", F.col("sha256").alias("now"))
    state = F.when(F.col("kind").isNull(), "missing").when(F.col("kind") == "symlink", "symlink").when(F.col("size") > most, "too_large").when(F.col("now") != F.col("sha256"), "changed").otherwise("ok")
    return wanted.join(f, "rel_path", "left").withColumn("state", state).drop("kind", "size", "now")
