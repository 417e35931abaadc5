"""Incremental take-up as streams, an extension: new files become rows of a case batch by batch, and tool uses wait for results that come in later files.

Three streams follow each other, each with a checkpoint in the case's folder, so each file and each block is taken once:

1. Files: a batch of new files is handed to one of the ingests, which adds what is new to the case's tables.
2. Blocks: the uses and results among new blocks are paired as far as a batch can tell, by windows over rows. What is settled is written. Of each key one row is left
   that says how its batch begins and ends: with a result whose use must be in an earlier batch, with a use whose result may still come.
3. Edges: these rows meet the state of their key, which is no more than the use that waits. So state and groups hold a row for each key and batch, however often an id is used.

A key is a root and an id of a tool use; the order is that of blocks, whose ids rise with each ingest. `pairs` gives the same rows as `tools.pair` over all blocks
at once, however the files were split into batches. A batch that is repeated after a failure replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import tools
from ..plans import ingest as transcripts

_PAIR = "root_id long, tool_use_id string, use_position long, result_position long, status string"
_EDGE = "root_id long, tool_use_id string, lead long, tail long, batch long"
_KEY = ["root_id", "tool_use_id"]


def stream(spark: SparkSession, root: str, glob: str, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Runs handle(files, batch) on new files below root until none is left. The checkpoint keeps what is done; contents are read only if handle asks for them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def take_up(case, path: str, label: str, by: Callable = transcripts.ingest, glob: str = "*") -> None:
    """Takes new files below path into the case by one of the ingests, batch by batch until none is left, and pairs what they bring."""

    def batch(files: DataFrame, _: int) -> None:
        if not files.isEmpty():
            by(case, path, label)

    stream(case.spark, path, glob, f"{case.path}/streams/files-{label}", batch).awaitTermination()
    advance(case)


def events(blocks: DataFrame, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """root_id, tool_use_id, position, kind of the uses and results among blocks."""
    kind = F.when(F.col("kind") == "tool_use", "use").otherwise("result")
    some = blocks.where("kind in ('tool_use', 'tool_result') and tool_use_id is not null").select("message_id", "tool_use_id", F.col("id").alias("position"), kind.alias("kind"))
    m = messages.select(F.col("id").alias("message_id"), "session_id").join(sessions.select(F.col("id").alias("session_id"), "root_id"), "session_id")
    return some.join(m, "message_id").select("root_id", "tool_use_id", "position", "kind")


def _keyed(found: DataFrame) -> DataFrame:
    return tools.pair(found.select(F.struct(*_KEY).alias("key"), "position", "kind")).select("key.*", "use_position", "result_position", "status")


def _split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the uses and results of a batch, the pairs that no other batch can change, and the edge of each key."""
    ends = found.groupBy(*_KEY).agg(F.min("position").alias("first"), F.max("position").alias("last"))
    pairs = _keyed(found).join(ends, _KEY)
    lead = (F.col("status") == "unpaired") & (F.col("result_position") == F.col("first"))
    tail = (F.col("status") == "unfinished") & (F.col("use_position") == F.col("last"))
    edges = pairs.groupBy(*_KEY).agg(F.max(F.when(lead, F.col("result_position"))).alias("lead"), F.max(F.when(tail, F.col("use_position"))).alias("tail"))
    return pairs.where(~lead & ~tail).select(*_KEY, "use_position", "result_position", "status"), edges


def _meet(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Edges of a key, a row a batch, against the use that waits for a result."""
    waits, out = (state.get[0] if state.exists else None), []
    edges = pd.concat(list(frames)).sort_values("batch")
    row = lambda use, result, status: out.append((*key, use, result, status))
    for lead, tail in zip(edges["lead"], edges["tail"], strict=True):
        if pd.notna(lead):
            row(waits, int(lead), "unpaired" if waits is None else "paired")
        elif waits is not None:
            row(waits, None, "unfinished")
        waits = int(tail) if pd.notna(tail) else None
    state.update((waits,))
    if waits is not None:
        row(waits, None, "open")
    frame = pd.DataFrame(out, columns=[*_KEY, "use_position", "result_position", "status"])
    yield frame.astype({"use_position": "Int64", "result_position": "Int64"})


def advance(case) -> None:
    """Pairs the uses and results of blocks that are new since the last call."""
    spark, at = case.spark, f"{case.path}/streams"
    if case.table("blocks").limit(1).isEmpty():
        return

    def settle(blocks: DataFrame, n: int) -> None:
        found = events(blocks, case.table("messages"), case.table("sessions")).persist()
        settled, edges = _split(found)
        settled.write.mode("overwrite").parquet(f"{at}/settled/batch={n}")
        edges.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{at}/edges/{n:012d}")
        found.unpersist()

    new = spark.readStream.schema(case.table("blocks").schema).parquet(f"{case.path}/blocks")
    new.writeStream.foreachBatch(settle).option("checkpointLocation", f"{at}/blocks-done").trigger(availableNow=True).start().awaitTermination()

    def keep(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/met/batch={n}")

    edges = spark.readStream.schema(_EDGE).option("recursiveFileLookup", "true").parquet(f"{at}/edges")
    met = edges.groupBy(*_KEY).applyInPandasWithState(_meet, _PAIR, "waits long", "update", GroupStateTimeout.NoTimeout)
    met.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/edges-done").trigger(availableNow=True).start().awaitTermination()


def pairs(case) -> DataFrame:
    """root_id, tool_use_id, use_position, result_position, status of all uses and results that were taken up; positions are ids of blocks."""
    spark, at = case.spark, f"{case.path}/streams"
    if case.table("blocks").limit(1).isEmpty():
        return spark.createDataFrame([], _PAIR)
    met = spark.read.schema(_PAIR).parquet(f"{at}/met")
    known = met.where("status <> 'open'").drop("batch")
    still = met.where("status = 'open'").drop("batch").distinct().join(known.where("use_position is not null").select(*_KEY, "use_position"), [*_KEY, "use_position"], "left_anti")
    out = spark.read.schema(_PAIR).parquet(f"{at}/settled").drop("batch").unionByName(known)
    return out.unionByName(still.withColumn("status", F.lit("unfinished"))).select(*_KEY, "use_position", "result_position", "status")


def pairs_at_once(case) -> DataFrame:
    """What `pairs` gives, worked out over all blocks."""
    return _keyed(events(case.table("blocks"), case.table("messages"), case.table("sessions")))
