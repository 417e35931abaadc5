"""Catalogue, sessions and their summaries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import day_end, day_start


def totals(**frames: DataFrame) -> DataFrame:
    """One row with the number of rows of each frame."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # rows of one
    return out


def by_status(files: DataFrame) -> DataFrame:
    return files.groupBy("parse_status").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.when(F.col("parse_status") == "parsed", F.col("record_count"))), F.lit(0)).cast("long").alias("records"))


def with_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """parents with the number of their children, 0 where there are none."""
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def summarise(messages: DataFrame) -> DataFrame:
    """Sessions from their messages: messages that are shown, all records, first and last ordinal."""
    return messages.groupBy("session_id").agg(F.count_if(F.col("role") != "meta").alias("message_count"), F.count("*").alias("record_count"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))


def overlapping(sessions: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Sessions whose time overlaps a range; a bare date means the whole UTC day, untimed sessions drop out."""
    if since:
        sessions = sessions.where(F.coalesce("last_ts", "first_ts") >= day_start(F.lit(since)))
    if until:
        sessions = sessions.where(F.coalesce("first_ts", "last_ts") <= day_end(F.lit(until)))
    return sessions


def containing(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose column holds a literal text, whatever the case of ASCII letters."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.where(F.contains(low(F.col(column)), low(F.lit(part))))


def having(sessions: DataFrame, others: DataFrame, key: str, other: str) -> DataFrame:
    """Sessions for which another frame has a row."""
    return sessions.join(others.select(F.col(other).alias(key)), key, "left_semi")


def bounds(records: DataFrame, mtime: DataFrame | None = None) -> DataFrame:
    """First and last time of each session with their origins: of the timed records, ties by ordinal; else the file's; else absent."""
    timed, key = F.col("timestamp").isNotNull(), F.struct("timestamp", "ordinal")
    at = F.when(timed, F.struct("timestamp", "ts_origin"))
    out = records.groupBy("session_id").agg(F.min_by(at, F.when(timed, key)).alias("a"), F.max_by(at, F.when(timed, key)).alias("b"))
    out = out.join(mtime, "session_id", "left") if mtime is not None else out.withColumn("mtime", F.lit(None).cast("string"))
    origin = lambda x: F.coalesce(F.col(f"{x}.ts_origin"), F.when(F.col("mtime").isNotNull(), "file_mtime"), F.lit("absent"))
    return out.select("session_id", F.coalesce("a.timestamp", "mtime").alias("first_ts"), origin("a").alias("first_ts_origin"), F.coalesce("b.timestamp", "mtime").alias("last_ts"), origin("b").alias("last_ts_origin"))


def models(records: DataFrame, column: str) -> DataFrame:
    """The distinct models of each session in order; an empty list without any."""
    return records.groupBy("session_id").agg(F.array_sort(F.collect_set(column)).alias("models"))


def generation(records: DataFrame) -> DataFrame:
    """The highest version of each root, compared number by number."""
    parts = F.transform(F.split("version", r"\."), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)))
    return records.groupBy("root_id").agg(F.max_by("version", parts).alias("generation"))


def merge_fields(drafts: DataFrame) -> DataFrame:
    """Sessions from drafts at positions: the last title wins, of other fields the first."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(c)
    return drafts.groupBy("session_id").agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.col("position"))).alias("title"), *(first(c) for c in drafts.columns if c not in ("session_id", "position", "title")))
