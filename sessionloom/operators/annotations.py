"""Annotations on rows of a case: what may be annotated, what stands, and what belongs to a message."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of targets with their tables, kinds of annotations, bytes of a value at most.
TARGETS = {"session": "sessions", "message": "messages", "block": "blocks", "tool_call": "tool_calls", "observation": "observations", "anomaly": "anomalies", "source_file": "source_files"}
KINDS = ["tag", "bookmark", "note"]
MOST_BYTES = 65536


def malformed() -> Column:
    """What is wrong with an annotation (target_type, kind, value) in itself; null where nothing is."""
    known = F.coalesce(F.col("target_type").isin(*TARGETS), F.lit(False))
    return (
        F.when(~known, F.concat(F.lit("unknown target type "), F.coalesce("target_type", F.lit("-"))))
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("-"))))
        .when(F.coalesce(F.regexp_replace("value", r"[\s\p{Z}]", "") == "", F.lit(True)), "empty value").when(F.octet_length("value") > MOST_BYTES, "value too long")
    )


def checked(wanted: DataFrame, case) -> DataFrame:
    """wanted (target_type, target_id, kind, value) with `refused`: why each may not be made, null where it may. The target has to exist; each type is one join with the ids of its table."""
    rows, there = wanted.withColumn("refused", malformed()), None
    for name, table in TARGETS.items():
        one = case.table(table).select(F.lit(name).alias("target_type"), F.col("id").cast("long").alias("target_id")).distinct()
        there = one if there is None else there.unionAll(one)
    rows = rows.join(there.withColumn("there", F.lit(True)), ["target_type", "target_id"], "left")
    gone = F.concat(F.lit("no "), "target_type", F.lit(" with id "), F.coalesce(F.col("target_id").cast("string"), F.lit("-")))
    return rows.withColumn("refused", F.coalesce("refused", F.when(F.col("there").isNull(), gone))).select(*wanted.columns, "refused")


def standing(events: DataFrame) -> DataFrame:
    """The annotations that stand: of each the last event, unless it removes it."""
    at = F.struct("created_at", "deleted")
    last = events.groupBy("id").agg(F.max_by(F.struct("target_type", "target_id", "kind", "value", "deleted"), at).alias("x"), F.min("created_at").alias("created_at"))
    return last.where(~F.col("x.deleted")).select("id", "x.target_type", "x.target_id", "x.kind", "x.value", "created_at")


def of_messages(notes: DataFrame, blocks: DataFrame, calls: DataFrame) -> DataFrame:
    """notes with message_id: the message annotated, the one whose block is, and those that hold the use or the result of a call that is. A union of equi joins; a call within one message counts once."""
    b = blocks.select(F.col("id").alias("block"), "message_id")
    of = lambda kind: notes.where(F.col("target_type") == kind)
    sides = F.explode(F.array_distinct(F.filter(F.array("tool_use_block_id", "tool_result_block_id"), lambda x: x.isNotNull())))
    held = calls.select(F.col("id").alias("target_id"), sides.alias("block")).join(b, "block").select("target_id", "message_id").distinct()
    columns = [*notes.columns, "message_id"]
    parts = [of("message").withColumn("message_id", F.col("target_id")), of("block").join(b.withColumnRenamed("block", "target_id"), "target_id"), of("tool_call").join(held, "target_id")]
    return parts[0].select(columns).unionAll(parts[1].select(columns)).unionAll(parts[2].select(columns))
