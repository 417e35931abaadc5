"""Versions, hashes, chains of snapshots."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(files: DataFrame, by: list[str]) -> DataFrame:
    """The newest version of each file."""
    w = Window.partitionBy(*by).orderBy(F.desc("version"))
    return files.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def supersede(files: DataFrame, by: list[str]) -> DataFrame:
    """files with their status: all but the newest version are superseded."""
    newest = F.max("version").over(Window.partitionBy(*by))
    return files.withColumn("parse_status", F.when(F.col("version") < newest, "superseded").otherwise(F.col("parse_status")))


def next_versions(files: DataFrame, changed: DataFrame, by: list[str]) -> DataFrame:
    """Changed files with the version after the newest known."""
    top = files.groupBy(*by).agg(F.max("version").alias("v"))
    return changed.join(top, by, "left").withColumn("version", F.coalesce("v", F.lit(0)) + 1).drop("v")


def chain(entries: DataFrame) -> DataFrame:
    """Snapshots of a resource in order, each with the one before it."""
    w = Window.partitionBy("resource").orderBy("position")
    return entries.select("resource", "position", F.lag("after").over(w).alias("before"), "after")


def verify(manifest: DataFrame, found: DataFrame, on: str = "rel_path") -> DataFrame:
    """rel_path, state: what a new hash of each file says about the manifest."""
    both = manifest.select(on, F.col("sha256").alias("was")).join(found.select(on, F.col("sha256").alias("now")), on, "full")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unindexed").when(F.col("was") != F.col("now"), "drift").otherwise("ok")
    return both.select(on, state.alias("state"))


def blobs(files: DataFrame) -> DataFrame:
    """One row for each content: hash, bytes, how many files hold it, the first of them."""
    return files.groupBy("sha256").agg(F.max("size").alias("size"), F.count("*").alias("files"), F.min("id").alias("first_id"))


def slice_of(content, offset, length, sha):
    """The bytes of a record, if their hash is the one on record."""
    part = F.substring(content, offset + 1, length)
    return F.when(F.sha2(part, 256) == sha, part)
