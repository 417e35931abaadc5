"""Which harness wrote a directory: a table of signs, judged on its listing.

A sign is a pattern of paths and, for some, what such a file has to hold: words near its beginning, or tables and a key of a database. Patterns are
matched on the rows of the listing; only files that match are opened, by tasks, and only their first bytes or their list of tables is read. Of each sign the first place counts,
a folder's own files before those of the folders in it, by name. What comes to the driver is one row for each sign that was found. Links are not followed.
"""

from __future__ import annotations

import os
import sqlite3

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest, sqlite

HEAD = 16 << 10

# Harness, kind of entry, pattern of its path, words that its beginning holds, tables that it has, key in the first of them, and what is said of it (with {} for the path).
SIGNS = [
    ("claude-code", "file", r"projects/(?:[^/]+/){0,3}[^/]*\.jsonl(?:$|\.(?:orphaned|superseded)-[^/]*)", ['"parentUuid"', '"sessionId"'], [], None, "projects transcript carrying parentUuid and sessionId: {}"),
    ("claude-code", "file", r"history\.jsonl", ['"display"', '"sessionId"'], [], None, "history.jsonl carrying display and sessionId"),
    ("claude-code", "dir", r"file-history", [], [], None, "file-history directory"),
    ("cursor", "dir", r"projects/[^/]+/agent-transcripts", [], [], None, "agent-transcripts directory: {}"),
    ("cursor", "file", r"chats/[^/]+/[^/]+/store\.db", [], ["blobs", "meta"], None, "chat store with tables blobs and meta: {}"),
    ("cursor", "dir", r"acp-sessions", [], [], None, "acp-sessions directory"),
    ("cursor", "file", r"ai-tracking/ai-code-tracking\.db", [], [], None, "ai-tracking/ai-code-tracking.db"),
    ("cursor", "file", r"prompt_history\.json", [], [], None, "prompt_history.json"),
    ("cursor-ide", "file", r"User/globalStorage/state\.vscdb", [], ["cursorDiskKV"], None, "User/globalStorage/state.vscdb with table cursorDiskKV"),
    ("cursor-ide", "file", r"User/workspaceStorage/[^/]+/state\.vscdb", [], ["ItemTable"], "composer.composerData", "{} with ItemTable key composer.composerData"),
]
# Kinds of stores whose generation shows in names and tables: kind, pattern of paths, tables, generation. The first that is found counts.
GENERATIONS = [
    ("cursor:agent-transcripts", r"projects/[^/]+/agent-transcripts/.*\.jsonl", [], "jsonl"),
    ("cursor:agent-transcripts", r"projects/[^/]+/agent-transcripts(?:/.*)?", [], "txt"),
    ("cursor:state-vscdb", r"User/globalStorage/state\.vscdb", ["cursorDiskKV"], "cursor-disk-kv"),
    ("cursor:state-vscdb", r"User/globalStorage/state\.vscdb", [], "itemtable-legacy"),
]
#: Levels of directories that hold all signs.
LEVELS = 5


def _holds(path: str, words: list[str], tables: list[str], key: str | None) -> bool:
    """Whether a file begins with the words, and is a database with the tables and, in the first of them, the key."""
    try:
        with open(path, "rb") as f:
            head = f.read(HEAD)
        if not all(w.encode() in head for w in words):
            return False
        if not tables:
            return True
        if head[:16] != b"SQLite format 3\0":
            return False
        with sqlite.opened(path, wal=False) as (con, _):
            return all(sqlite.ordinary(con, t) for t in tables) and (key is None or con.execute(f'SELECT 1 FROM "{tables[0]}" WHERE key = ? LIMIT 1', (key,)).fetchone() is not None)
    except (OSError, sqlite3.DatabaseError):
        return False


def _marked(spark: SparkSession, listed: DataFrame, root: str, wanted: list[tuple[str | None, str, list[str], list[str], str | None]]) -> DataFrame:
    """inside, rel_path, n: of each directory in `inside` and each wanted thing (its number n: kind of entry, pattern, words, tables, key), the first place. listed: inside, rel_path, kind; inside is a path below root, or empty."""
    match = F.array(*(F.when(F.col("rel_path").rlike(f"^(?:{pattern})$") & (F.lit(True) if kind is None else F.col("kind") == kind), F.lit(n)) for n, (kind, pattern, *_) in enumerate(wanted)))
    rows = listed.where("kind in ('file', 'dir')").select("inside", "rel_path", F.explode(F.filter(match, lambda x: x.isNotNull())).alias("n"))

    @F.pandas_udf("boolean")
    def held(inside: pd.Series, rel: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([not any(wanted[k][2:4]) or _holds(os.path.join(root, i, r), *wanted[k][2:]) for i, r, k in zip(inside, rel, n, strict=True)], dtype=bool)

    parts = F.split("rel_path", "/")
    place = F.transform(parts, lambda x, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), x))
    return rows.where(held("inside", "rel_path", "n")).groupBy("inside", "n").agg(F.min_by("rel_path", place).alias("rel_path"))


def signs(spark: SparkSession, listed: DataFrame, root: str) -> DataFrame:
    """inside, harness, signs (what was found, in the order of the table) of each directory in `inside` that bears any."""
    found = _marked(spark, listed, root, [(kind, pattern, words, tables, key) for _, kind, pattern, words, tables, key, _ in SIGNS])
    of = lambda k: F.element_at(F.array(*(F.lit(s[k]) for s in SIGNS)), F.col("n") + 1)
    said = found.select("inside", "n", of(0).alias("harness"), F.replace(of(6), F.lit("{}"), "rel_path").alias("sign"))
    return said.groupBy("inside", "harness").agg(F.min("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("n", "sign"))), lambda x: x["sign"]).alias("signs")).orderBy("inside", "n").drop("n")


def identify(spark: SparkSession, root: str, listed: DataFrame | None = None) -> dict[str, list[str]]:
    """The harnesses that a directory bears signs of, each with those signs. listed: its listing, if there is one."""
    listed = manifest.listing(spark, root, LEVELS) if listed is None else listed
    return {r["harness"]: r["signs"] for r in signs(spark, listed.withColumn("inside", F.lit("")), root).collect()}


def candidates(spark: SparkSession, root: str) -> DataFrame:
    """inside, harness, signs of the directories in a directory, one level down, that bear signs of a harness."""
    parts = F.split("rel_path", "/", 2)
    below = manifest.listing(spark, root, LEVELS + 1).select(parts[0].alias("inside"), F.try_element_at(parts, F.lit(2)).alias("rel_path"), "kind")
    return signs(spark, below.where("rel_path is not null"), root)


def generations(spark: SparkSession, root: str, listed: DataFrame) -> dict[str, str]:
    """The generation of stores that shows in names and tables; that of transcripts with versions is in their records."""
    found = _marked(spark, listed.withColumn("inside", F.lit("")), root, [(None, pattern, [], tables, None) for _, pattern, tables, _ in GENERATIONS])
    out = {"cursor:chat-store": "store-db"}
    for n in sorted((r["n"] for r in found.select("n").collect()), reverse=True):
        out[GENERATIONS[n][0]] = GENERATIONS[n][3]
    return out
