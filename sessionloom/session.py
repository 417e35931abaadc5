"""The session that the operators expect."""

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "sessionloom", **conf: str) -> SparkSession:
    """UTC times and adaptive plans; all else, such as partitions and memory, is the cluster's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names (spark.checkpoint.dir). Only a local session, of one machine, may do without: it gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """df with its lineage cut: written once to the shared folder, read from there by every later step. files: at most so many files, for what is small."""
    checkpoint_dir(df.sparkSession)
    return (df.coalesce(files) if files else df).checkpoint()


def ordered_numbers(rows: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """rows with their place, from 0 without gaps, in an order of the whole table. The sort is by ranges, written once; each range counts its own rows, and only one row a range is summed up in one task."""
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33))
    heads = rows.groupBy("_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_size"))
    heads = heads.select("_part", F.expr("_first - coalesce(sum(_size) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_start"))
    return rows.join(heads, "_part").withColumn(name, F.col("_row") - F.col("_start")).drop("_row", "_part", "_start")
