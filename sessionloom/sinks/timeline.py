"""Timelines as JSON lines, CSV and Parquet, each ordered as a whole.

The events are sorted by ranges and written once; each range is a part. The sizes of the parts, a row each, give every part its place, and
the parts are written side by side: lines at their offset of the one file, Parquet rows as files of their own row groups. No rows pass through the driver,
and no task holds more than one part. A task that is repeated writes the same bytes to the same place.

A Parquet timeline of one part is a file. One of several parts is a folder of files in order, with the row groups of all of them in `_metadata`. Writers need a folder that all
executors see under the same path.
"""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Events of a part, about.
PART = 1_000_000

# The columns that every row has.
FIXED = ["datetime", "timestamp_desc", "message", "source", "source_long", "display_name", "tag"]
PARQUET = "source_file file_hash byte_offset content_hash message timestamp timestamp_desc artifact artifact_long display_name tags attributes locator".split()


def json_lines(events: DataFrame) -> DataFrame:
    """value: one JSON object for each event, the attributes among its members; keys that are taken are skipped."""
    own = F.to_json(F.struct(*(F.col(c) for c in FIXED[:-1]), F.col("tags").alias("tag")), {"ignoreNullFields": "false"})
    rest = F.to_json(F.map_filter("attributes", lambda k, v: ~k.isin(*FIXED, "tags")))
    merged = F.concat(F.expr("substring(_own, 1, length(_own) - 1)"), F.lit(","), F.expr("substring(_rest, 2)"))
    return events.select(own.alias("_own"), rest.alias("_rest")).select(F.when(F.col("_rest") == "{}", F.col("_own")).otherwise(merged).alias("value"))


def order() -> list[str | Column]:
    """By time, events without one last; then messages, calls, observations; then id."""
    return [F.col("datetime").asc_nulls_last(), "rank", "id"]


def sorted_parts(events: DataFrame, part: int = PART) -> DataFrame:
    """events in their order, dealt into ranges that follow each other; written once, so that ranges stay as they are."""
    n = max(1, -(-events.count() // part))
    return cut(events.repartitionByRange(n, *order()).sortWithinPartitions(*order()))


def write_lines(lines: DataFrame, path: str, head: bytes = b"") -> list[dict]:
    """Writes the column value of sorted parts as lines of one file after some first bytes; gives the manifest of the parts: number, rows, offset and bytes."""
    numbered = lines.select("value", F.spark_partition_id().alias("part"))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("rows"), F.sum(F.octet_length("value") + 1).alias("bytes")).orderBy("part").collect()  # a row for each part
    manifest, at = [], len(head)
    for r in sizes:
        manifest.append({"part": r["part"], "rows": r["rows"], "offset": at, "bytes": r["bytes"]})
        at += r["bytes"]
    with open(path, "xb") as f:
        f.write(head)
        f.truncate(at)
    offsets = {m["part"]: m["offset"] for m in manifest}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "r+b") as f:
            f.seek(offsets.get(TaskContext.get().partitionId(), 0))
            for batch in batches:
                f.write("".join(f"{v}\n" for v in batch["value"].to_pylist()).encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_pylist([], schema=pa.schema([("done", pa.int32())]))

    lines.select("value").mapInArrow(write, "done int").count()
    return manifest


def write_json_lines(events: DataFrame, path: str, part: int = PART) -> list[dict]:
    return write_lines(json_lines(sorted_parts(events, part)), path)


def csv_frame(events: DataFrame) -> DataFrame:
    """The fixed columns and one for each attribute, in order of name; the first pass finds the names."""
    keys = sorted(r[0] for r in events.select(F.explode(F.map_keys("attributes"))).distinct().collect() if r[0] not in (*FIXED, "tags"))
    return events.select(*FIXED[:-1], F.array_join("tags", ",").alias("tag"), *(F.coalesce(F.try_element_at("attributes", F.lit(k)), F.lit("")).alias(k) for k in keys))


def write_csv(events: DataFrame, path: str, part: int = PART) -> list[dict]:
    rows = csv_frame(sorted_parts(events, part))
    line = lambda df: df.select(F.to_csv(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"emptyValue": "", "nullValue": ""}).alias("value"))
    names = events.sparkSession.createDataFrame([tuple(rows.columns)], ", ".join(f"c{i} string" for i in range(len(rows.columns))))
    return write_lines(line(rows), path, (line(names).first()["value"] + "\n").encode())


def original_files(events: DataFrame) -> DataFrame:
    """The files that events come from: of each hash and path what its first event says."""
    first = F.struct(F.col("datetime").isNull(), "datetime", "rank", "id")
    return events.groupBy("file_hash", "source_file").agg(F.min_by(F.struct("file_size", "file_mtime"), first).alias("x")).select("file_hash", "source_file", "x.*").orderBy("file_hash", "source_file")


def _facts(events: DataFrame, rows: int, converter: str, version: str, now: str) -> dict[str, str]:
    """What the footer says of a conversion. The format wants all files named there, so their list is one text."""
    name = F.element_at(F.split("source_file", "/"), -1)
    one = F.struct(F.col("file_hash").alias("h"), F.col("source_file").alias("p"), F.struct(name.alias("name"), F.col("file_hash").alias("sha256"), F.col("file_size").alias("size_bytes"), F.col("source_file").alias("path"), F.col("file_mtime").alias("mtime")).alias("x"))
    listed = F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["x"]), {"ignoreNullFields": "false"})
    files = original_files(events).agg(listed.alias("files")).first()["files"]
    return {"format_version": "1", "converter_name": converter, "converter_version": version, "original_files": files, "converted_at": now, "row_counts": json.dumps({"parsed": rows, "skipped_malformed": 0, "skipped_by_time": 0}), "timezone_assumption": "all timestamps stored UTC; origin per row in timestamp_desc and attributes.ts_origin"}


def write_parquet(events: DataFrame, path: str, footer_prefix: str = "timeline", converter: str = "sessionloom", version: str = "1", now: str = "", part: int = PART) -> int:
    """Parquet with facts about the conversion in its footers and in the Arrow schema; gives the number of rows."""
    parts = sorted_parts(events, part)
    rows = parts.count()
    facts = {f"{footer_prefix}.{k}": v for k, v in _facts(parts, rows, converter, version, now).items()}
    text = pa.string()
    schema = pa.schema([pa.field(c, {"byte_offset": pa.uint64(), "timestamp": pa.timestamp("ms", "UTC"), "tags": pa.list_(text), "attributes": pa.map_(text, text)}.get(c, text), nullable=c in ("timestamp", "locator")) for c in PARQUET], facts)
    n = parts.rdd.getNumPartitions()
    if n > 1:
        os.makedirs(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = f"{path}/part-{TaskContext.get().partitionId():06d}.parquet" if n > 1 else path
        own = f"{at}.{TaskContext.get().taskAttemptId()}"  # of this attempt alone until it is whole
        with pq.ParquetWriter(own, schema) as out:
            out.add_key_value_metadata(facts)
            for batch in batches:
                out.write_table(_table(batch.to_pylist(maps_as_pydicts="strict"), schema))
        os.replace(own, at)
        yield pa.RecordBatch.from_pylist([], schema=pa.schema([("done", pa.int32())]))

    parts.mapInArrow(write, "done int").count()
    if n > 1:
        footers = {name: pq.read_metadata(f"{path}/{name}") for name in sorted(os.listdir(path)) if name.endswith(".parquet")}  # footers only, one for each part
        for name, m in footers.items():
            m.set_file_path(name)
        pq.write_metadata(schema, f"{path}/_metadata", metadata_collector=list(footers.values()))
    elif not rows and not os.path.exists(path):  # without rows there may be no task either
        pq.write_table(schema.empty_table(), path)
    return rows


def _table(batch: list, schema: pa.Schema) -> pa.Table:
    at = lambda s: None if s is None else datetime.datetime.fromisoformat(s)
    of = {"timestamp": lambda r: at(r["datetime"]), "artifact": lambda r: r["source"], "artifact_long": lambda r: r["source_long"], "attributes": lambda r: sorted(r["attributes"].items())}
    return pa.table({c: pa.array([of.get(c, lambda r, c=c: r[c])(r) for r in batch], schema.field(c).type) for c in schema.names}, schema)
