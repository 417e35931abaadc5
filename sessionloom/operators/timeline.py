"""The event timeline: three streams in one shape."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import source_of, timestamp_desc, tool_summary, truncate

INFERRED = "Session Start (inferred, record has no timestamp)"


def attributes(**values: Column) -> Column:
    """A map of the values that are not null or empty, in order of key."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sorted(values.items())))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != "")))


def events(rows: DataFrame, what: str, rank: int, message: Column, **extra: Column) -> DataFrame:
    """rows (id, timestamp, ts_origin, session_first_ts, harness, session_id, locator, byte_offset) as events: a row without a time stands at its session's start."""
    timed, start = F.col("timestamp").isNotNull(), F.col("session_first_ts")
    desc = F.when(~timed & start.isNotNull(), INFERRED).otherwise(timestamp_desc(what, F.col("ts_origin")))
    place = {"evidence_locator": F.col("locator"), "evidence_byte_offset": F.when(F.col("locator").isNull(), F.col("byte_offset"))}
    return rows.select(
        F.lit(rank).alias("rank"), "id", F.coalesce("timestamp", start).alias("datetime"), desc.alias("timestamp_desc"), message.alias("message"), source_of(F.col("harness")).alias("source"), "session_id",
        F.when(~timed & start.isNotNull(), F.array(F.lit("inferred"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        attributes(harness=F.col("harness"), session_id=F.col("session_id"), ts_origin=F.col("ts_origin"), record_kind=F.lit(what.lower()), **place, **extra).alias("attributes"),
    )


def scoped(timeline: DataFrame, session: int | None = None) -> DataFrame:
    return timeline if session is None else timeline.where(F.col("session_id") == session)


# --- the timeline of a case ------------------------------------------------------------------------


def check_scope(case, root_id: int | None = None, session_id: int | None = None) -> None:
    """Refuses a root or session that the case does not hold."""
    for name, of in (("evidence_roots", root_id), ("sessions", session_id)):
        if of is not None and case.table(name).where(F.col("id") == of).isEmpty():
            raise KeyError(f"{name} has no {of}")


def of_case(case, root_id: int | None = None, session_id: int | None = None) -> DataFrame:
    """One event for each message, tool call and observation of a case, a root or a session, with the record and file that it comes from.

    What has no record, file or root is left out. Without an order; exports have one."""
    check_scope(case, root_id, session_id)
    s = case.table("sessions").select(F.col("id").alias("session_id"), "root_id", F.col("harness_session_id").alias("session_name"), F.col("kind").alias("session_kind"), "project_path", F.col("first_ts").alias("session_first_ts"))
    s = s if root_id is None else s.where(F.col("root_id") == root_id)
    s = s if session_id is None else s.where(F.col("session_id") == session_id)
    s = s.join(case.table("evidence_roots").select(F.col("id").alias("root_id"), "harness", F.col("label").alias("root_label")), "root_id")
    files = case.table("source_files").select(F.col("id").alias("source_file_id"), F.col("rel_path").alias("source_file"), F.col("sha256").alias("file_hash"), F.col("size").alias("file_size"), F.col("mtime").alias("file_mtime"))
    records = case.table("provenance").select(F.col("id").alias("record"), "source_file_id", "byte_offset", F.col("content_sha256").alias("content_hash"), "locator").join(files, "source_file_id")
    origin = F.coalesce("timestamp_origin", F.lit("absent")).alias("ts_origin")

    m = case.table("messages").join(s.select("session_id"), "session_id", "left_semi")
    blocks = case.table("blocks").join(m.select(F.col("id").alias("message_id")), "message_id", "left_semi")
    body = blocks.where("kind = 'text' and text is not null").groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("body"))
    told = m.join(body.withColumnRenamed("message_id", "id"), "id", "left").select("id", "session_id", F.col("provenance_id").alias("record"), "timestamp", origin, "role", "record_type", "uuid", "model", "body")
    said = F.when(F.coalesce(F.length("body"), F.lit(0)) == 0, F.concat(F.lit("<"), "record_type", F.lit(">"))).otherwise(truncate(F.col("body"), 4000))
    told = _placed(told.join(s, "session_id").join(records, "record"), "message", "Message Timestamp", 0, F.concat("role", F.lit(": "), said), "role", [F.col("role")], role=F.col("role"), record_type=F.col("record_type"), message_uuid=F.col("uuid"), model=F.col("model"))

    of_block = blocks.join(m.select(F.col("id").alias("message_id"), F.col("provenance_id").alias("record"), F.col("timestamp"), "timestamp_origin"), "message_id").select(F.col("id").alias("block"), "record", "timestamp", "timestamp_origin")
    calls = case.table("tool_calls").join(s.select("session_id"), "session_id", "left_semi")
    begun = calls.withColumnRenamed("tool_use_block_id", "block").join(of_block, "block").select("id", "session_id", "record", "timestamp", origin, "name", "category", "input", "is_error")
    about = F.concat(F.lit("tool "), "name", F.lit(": "), tool_summary(F.col("input")))
    begun = _placed(begun.join(s, "session_id").join(records, "record"), "tool_call", "Tool Call Started", 1, about, "category", [F.lit("tool_call"), F.col("category")], tool_name=F.col("name"), tool_category=F.col("category"), tool_error=F.coalesce("is_error", F.lit(False)))

    o = case.table("observations").join(s.select("session_id"), "session_id", "left_semi")
    o = o.select("id", "session_id", "timestamp", origin, "kind", "path", "command", "confidence", F.col("derived_from_provenance_id").alias("record"), F.col("derived_from_block_id").alias("block"), F.col("derived_from_tool_call_id").alias("call"))
    keep = [c for c in o.columns if c not in ("record", "block", "call")] + ["record"]
    by_record = o.where("record is not null").select(keep)
    by_block = o.where("record is null and block is not null").drop("record").join(of_block.select("block", "record"), "block").select(keep)
    use = calls.select(F.col("id").alias("call"), F.col("tool_use_block_id").alias("block")).join(of_block.select("block", "record"), "block").select("call", "record")
    by_call = o.where("record is null and block is null and call is not null").drop("record").join(use, "call").select(keep)
    seen = by_record.unionByName(by_block).unionByName(by_call)
    what = F.concat("kind", F.lit(": "), truncate(F.coalesce("command", "path", F.lit("")), 500))
    seen = _placed(seen.join(s, "session_id").join(records, "record"), "observation", "Observation Time", 2, what, "kind", [F.lit("observation"), F.col("kind"), F.col("confidence")], observation_kind=F.col("kind"), path=F.col("path"), command=F.col("command"), confidence=F.col("confidence"))
    return told.unionByName(begun).unionByName(seen)


def _placed(rows: DataFrame, kind: str, what: str, rank: int, message: Column, of: str, tags: list[Column], **extra: Column) -> DataFrame:
    """rows, joined with their sessions and records, as events; one without a time stands at its session's start."""
    timed, start, slug = F.col("timestamp").isNotNull(), F.col("session_first_ts"), F.replace("harness", F.lit("-"), F.lit("_"))
    inferred = ~timed & start.isNotNull()
    return rows.select(
        F.lit(rank).alias("rank"), "id", F.coalesce("timestamp", start).alias("datetime"), F.when(inferred, INFERRED).otherwise(timestamp_desc(what, F.col("ts_origin"))).alias("timestamp_desc"),
        F.concat(F.lit("["), "harness", F.lit("] "), message).alias("message"), source_of(F.col("harness")).alias("source"), F.concat(slug, F.lit(f":{kind}:"), of).alias("source_long"), F.concat("root_label", F.lit(":"), "source_file").alias("display_name"),
        F.filter(F.array(F.col("harness"), *tags, F.col("ts_origin"), F.when(inferred, "inferred")), lambda t: t.isNotNull()).alias("tags"),
        attributes(
            harness=F.col("harness"), root_label=F.col("root_label"), session_db_id=F.col("session_id"), session_id=F.col("session_name"), session_kind=F.col("session_kind"), project_path=F.col("project_path"), record_kind=F.lit(kind), ts_origin=F.col("ts_origin"),
            evidence_file=F.col("source_file"), evidence_file_sha256=F.col("file_hash"), evidence_locator=F.col("locator"), evidence_byte_offset=F.when(F.col("locator").isNull(), F.col("byte_offset")), evidence_record_sha256=F.col("content_hash"), **extra,
        ).alias("attributes"),
        "session_id", "source_file", "file_hash", "byte_offset", "content_hash", "locator", "file_size", "file_mtime",
    )
