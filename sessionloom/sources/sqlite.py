"""Tables of SQLite files, read-only, as a Spark data source: a file of several ranges is read by as many tasks.

Options: path (one file, or several parted by line breaks), table, prefix (of the column key; read as
a range), maxBytes (longer values are left null, their length is given), rangeBytes (bytes of a file for each
range), wal (apply a write-ahead log of up to 256 MiB to a private copy). Only ordinary tables are read; views and virtual tables count as absent.

How many ranges a file has follows from sizes alone; where there would be more than RANGES in all, ranges are longer. Each task asks the database itself for the bounds of its row numbers
and takes its share of them, so the driver opens no database; rows come in order within a range and ranges in order of their
numbers. A file whose log has to be applied is one range, as each task would need a copy of its own.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import sqlite3
import tempfile
import urllib.parse

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, StringStartsWith

WAL_CAP, VALUE_CAP, RANGE, RANGES = 256 << 20, 64 << 20, 128 << 20, 1024


def connect(path: str, immutable: bool = True) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro" + ("&immutable=1" if immutable else ""), uri=True)
    con.execute("PRAGMA trusted_schema = OFF")
    con.execute("PRAGMA query_only = ON")
    con.setconfig(sqlite3.SQLITE_DBCONFIG_DEFENSIVE, True)
    con.text_factory = bytes
    return con


def ordinary(con: sqlite3.Connection, table: str) -> bool:
    row = con.execute("SELECT sql FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone()
    return row is not None and not (row[0] or b"").upper().startswith(b"CREATE VIRTUAL")


def after(prefix: str) -> str:
    """The least text above all that begin with prefix."""
    return prefix[:-1] + chr(ord(prefix[-1]) + 1)


@contextlib.contextmanager
def opened(path: str, wal: bool):
    """A connection to a database and whether its write-ahead log is applied, to a private copy."""
    log, copy = path + "-wal", None
    applied = wal and os.path.exists(log) and 0 < os.path.getsize(log) <= WAL_CAP
    try:
        if applied:
            copy = tempfile.mkdtemp()
            for p in (path, log):
                shutil.copy(p, copy)
            path = os.path.join(copy, os.path.basename(path))
        with contextlib.closing(connect(path, immutable=not applied)) as con:
            yield con, applied
    finally:
        if copy:
            shutil.rmtree(copy)


@F.pandas_udf(T.ArrayType(T.StringType()))
def tables_udf(path: pd.Series, names: pd.Series) -> pd.Series:
    """Which of the ordinary tables that names lists, parted by spaces, the database at a path has; none where it is no database."""
    out = []
    for p, wanted in zip(path, names, strict=True):
        try:
            with opened(p, wal=True) as (con, _):
                out.append([t for t in wanted.split(" ") if ordinary(con, t)])
        except sqlite3.DatabaseError:
            out.append([])
    return pd.Series(out, dtype=object)


class _Range(InputPartition):
    """One of `of` ranges of a database."""

    def __init__(self, path: str, number: int, of: int):
        super().__init__((path, number))
        self.path, self.number, self.of = path, number, of


def _bounds(con: sqlite3.Connection, table: str, number: int, of: int) -> tuple[int, int] | None:
    """The least row number of a range and that of the next one. None where the table is empty."""
    least, most = con.execute(f"SELECT (SELECT min(rowid) FROM {table}), (SELECT max(rowid) FROM {table})").fetchone()  # both in one SELECT would be a scan
    if least is None:
        return None
    at = lambda k: least + (most - least + 1) * k // of
    return at(number), at(number + 1)


class SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split("\n") if p]
        self.table, self.key, self.value = options["table"], options.get("key", "key"), options.get("value", "value")
        self.prefix, self.equal = options.get("prefix"), None
        self.cap, self.wal = int(options.get("maxbytes", VALUE_CAP)), options.get("wal", "ignore") == "auto"
        self.range = int(options.get("rangebytes", RANGE))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("key",) and not self.prefix:
                self.prefix = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("key",) and isinstance(f.value, str):
                self.equal = f.value
            yield f  # applied again by Spark

    def partitions(self):
        length = max(self.range, sum(os.path.getsize(p) for p in self.paths if os.path.exists(p)) // RANGES)
        return [_Range(p, k, n) for p in self.paths for n in [self._ranges(p, length)] for k in range(n)]

    def _ranges(self, path: str, length: int) -> int:
        log = path + "-wal"
        if self.wal and os.path.exists(log) and os.path.getsize(log) > 0:
            return 1
        return max(1, -(-os.path.getsize(path) // length)) if os.path.exists(path) else 1

    def read(self, partition):
        with opened(partition.path, self.wal) as (con, applied):
            if not ordinary(con, self.table):
                return
            where, values = [], []
            if self.prefix:
                where, values = ["k >= ?", "k < ?"], [self.prefix, after(self.prefix)]
            if self.equal is not None:
                where, values = [*where, "k = ?"], [*values, self.equal]
            q = lambda s: '"' + s.replace('"', '""') + '"'
            if partition.of > 1:
                if (bounds := _bounds(con, q(self.table), partition.number, partition.of)) is None:
                    return
                where, values = [*where, "rowid >= ?", "rowid < ?"], [*values, *bounds]
            # by an index of keys each range would come to the keys of all ranges
            rows = q(self.table) + (" NOT INDEXED" if partition.of > 1 and self.equal is None else "")
            sql = f"SELECT rowid, k, n, CASE WHEN n <= {self.cap} THEN v END FROM (SELECT rowid, {q(self.key)} AS k, CAST({q(self.value)} AS BLOB) AS v, length(CAST({q(self.value)} AS BLOB)) AS n FROM {rows})"
            for rowid, k, n, v in con.execute(sql + (" WHERE " + " AND ".join(where) if where else "") + " ORDER BY rowid", values):
                yield partition.path, rowid, k.decode("utf-8", "replace") if isinstance(k, bytes) else None if k is None else str(k), n, v, applied


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "sqlite_kv"

    def schema(self):
        return "path string, row long, key string, size long, value binary, wal_applied boolean"

    def reader(self, schema):
        return SqliteReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def scan(spark: SparkSession, paths: list[str], table: str, **options: str):
    register(spark)
    reader = spark.read.format("sqlite_kv").option("path", "\n".join(paths)).option("table", table)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
