"""Tool calls: pairing, runs, names."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair(stream: DataFrame) -> DataFrame:
    """Uses and results of one key in order: a use and the result right after it are a call, a use without one is unfinished, a result without a use before it is unpaired. Gives use_position, result_position, status."""
    w = Window.partitionBy("key").orderBy("position")
    near = stream.select("key", "position", "kind", F.lead("kind").over(w).alias("next"), F.lead("position").over(w).alias("next_position"), F.lag("kind").over(w).alias("before"))
    paired = F.coalesce((F.col("kind") == "use") & (F.col("next") == "result"), F.lit(False))
    lone = (F.col("kind") == "result") & ~F.coalesce(F.col("before") == "use", F.lit(False))
    return near.where((F.col("kind") == "use") | lone).select(
        "key",
        F.when(F.col("kind") == "use", F.col("position")).alias("use_position"),
        F.when(lone, F.col("position")).when(paired, F.col("next_position")).alias("result_position"),
        F.when(lone, "unpaired").when(paired, "paired").otherwise("unfinished").alias("status"),
    )


def emission_order(pairs: DataFrame, stream: DataFrame) -> DataFrame:
    """Calls numbered as they are given out: at their result, at the use that displaces them, or at the end."""
    w = Window.partitionBy("key").orderBy("position")
    displaced = stream.where("kind = 'use'").select("key", F.col("position").alias("use_position"), F.lead("position").over(w).alias("displaced_at"))
    at = F.coalesce("result_position", "displaced_at")
    order = Window.partitionBy("file").orderBy(at.asc_nulls_last(), "use_position")
    return pairs.where("status <> 'unpaired'").join(displaced, ["key", "use_position"], "left").withColumn("number", F.row_number().over(order))


def runs(records: DataFrame) -> DataFrame:
    """Maximal runs of records of one kind within a stream; more than five are folded."""
    w = Window.partitionBy("stream").orderBy("position")
    new = F.coalesce((F.lag("kind").over(w) != F.col("kind")).cast("int"), F.lit(1))
    numbered = records.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("stream", "run", "kind").agg(F.count("*").alias("calls"), F.min("position").alias("first_position")).withColumn("folded", F.col("calls") > 5)


def name_frequency(records: DataFrame) -> DataFrame:
    """How often each name occurs in a stream, most frequent first, ties by first use, as one line."""
    counts = records.groupBy("stream", "name").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    label = F.when(F.col("n") > 1, F.concat("name", F.lit(" ×"), F.col("n").cast("string"))).otherwise(F.col("name"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", label.alias("label"))))
    return counts.groupBy("stream").agg(F.array_join(F.transform(ordered, lambda x: x["label"]), ", ").alias("names"), F.sum("n").cast("long").alias("calls"))


def rollup(calls: DataFrame) -> DataFrame:
    """Status of each run of calls: the worst, and how many there are of each."""
    e, u = F.count_if(F.col("status") == "error"), F.count_if(F.col("status") == "no result")
    return calls.groupBy("stream").agg(e.alias("errors"), u.alias("unfinished"), F.count("*").alias("calls"), F.when(e > 0, "error").when(u > 0, "no result").otherwise("ok").alias("status"))
