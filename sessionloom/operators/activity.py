"""Observations and anomalies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# The kinds of observations on each page of activity.
KINDS = {
    "commands": ["command_executed", "subagent_spawned"],
    "files": ["file_read", "file_written", "file_edited", "file_deleted"],
    "indicators": ["url_referenced", "secret_candidate", "paste_detected", "upload_detected"],
}
SEVERITIES = ["info", "warning", "error"]


def of_kinds(observations: DataFrame, page: str) -> DataFrame:
    return observations.where(F.col("kind").isin(*KINDS[page]))


def masked(kind: Column, details: Column) -> Column:
    """Details of an observation, those of a secret with its match covered."""
    d = F.from_json(details, "rule string, rule_version string, field string, offset bigint, length bigint, match string, paste_id string")
    covered = F.to_json(F.struct(*(text.mask(d[k]).alias(k) if k == "match" else d[k].alias(k) for k in ("rule", "rule_version", "field", "offset", "length", "match", "paste_id"))))
    return F.when((kind == "secret_candidate") & d["match"].isNotNull(), covered).otherwise(details)


def with_message(observations: DataFrame, blocks: DataFrame, calls: DataFrame, messages: DataFrame) -> DataFrame:
    """observations with the message that each comes from: of its block, else of its call's use, else of its record."""
    b = blocks.select(F.col("id").alias("from_block"), F.col("message_id").alias("m1"))
    c = calls.join(blocks.select(F.col("id").alias("use_block"), F.col("message_id").alias("m2")), "use_block").select(F.col("id").alias("from_call"), "m2")
    r = messages.groupBy(F.col("record").alias("from_record")).agg(F.min("id").alias("m3"))
    joined = observations.join(b, "from_block", "left").join(c, "from_call", "left").join(r, "from_record", "left")
    return joined.withColumn("message_id", F.coalesce("m1", "m2", "m3")).drop("m1", "m2", "m3")


def of_message(observations: DataFrame, block: DataFrame, call: DataFrame, record: DataFrame) -> DataFrame:
    """Observations by any of three keys: a union of semi joins, so that each is an equi join."""
    parts = [observations.join(k, c, "left_semi") for k, c in ((block, "from_block"), (call, "from_call"), (record, "from_record"))]
    return parts[0].union(parts[1]).union(parts[2]).dropDuplicates(["id"])


def severity_rank(severity):
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def filtered(anomalies: DataFrame, **wanted) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            anomalies = anomalies.where(F.col(column) == value)
    return anomalies


def groups(anomalies: DataFrame) -> DataFrame:
    """Anomalies of one kind and message: how many, the first, the worst severity."""
    return anomalies.groupBy("kind", "message").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max_by("severity", severity_rank(F.col("severity"))).alias("worst"))
