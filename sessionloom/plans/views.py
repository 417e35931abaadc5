"""Canonical frames projected from plain tables, and the same projections as SQL common table expressions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    role = F.when(F.col("role") == "system", "meta").otherwise(F.col("role"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), role.alias("role"), "text")


def files(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    status = F.when(F.col("lang") == "en", "parsed").when(F.col("lang") == "fr", "inventoried").when(F.col("lang") == "de", "failed").otherwise("unparsed")
    return t.select(
        F.col("doc_id").alias("id"), F.col("source").alias("root"), F.col("lang").alias("store"), F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"),
        F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), F.lit(1).cast("long").alias("version"), status.alias("parse_status"), F.col("n_chars").alias("record_count"), "text",
    )


def observations(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    t = F.col("event_type")
    kind = F.when(t == "view", "file_read").when(t == "click", "command_executed").when(t == "purchase", "file_written").when(t == "signup", "upload_detected").otherwise("anomaly")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), kind.alias("kind"), stored(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("props").alias("details"), "value")


def anomalies(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'")
    severity = F.when(F.col("value") < 10, "info").when(F.col("value") < 100, "warning").otherwise("error")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.lit("malformed_record").alias("kind"), severity.alias("severity"), F.concat(F.lit("value of "), F.pmod(F.col("user_id"), F.lit(7)).cast("string")).alias("message"))


def stream(spark, d) -> DataFrame:
    """Uses and results: clicks and purchases of each user."""
    e = table(spark, d, "events").where("event_type in ('click', 'purchase')")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("position"), F.when(F.col("event_type") == "click", "use").otherwise("result").alias("kind"))


def records(spark, d) -> DataFrame:
    """Cards: events of each user, errors hidden, turn keys by type."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("position"), F.lit("assistant").alias("role"), F.col("event_type").alias("turn_key"), (F.col("event_type") == "error").alias("hidden"))


def forest(spark, d) -> DataFrame:
    """Customers as sessions: long chains, cycles of two, trees that hang on cycles, before and after them in the list, and parents that are not listed."""
    c = F.col("c_custkey")
    parent = F.when(c % 5 == 0, F.when(c % 1000 != 0, c - 5)).when(c % 5 == 1, c + 1).when(c % 5 == 2, c - 1).when(c % 10 == 3, c + 3).when(c % 10 == 8, c - 2).otherwise(c - 1)
    return table(spark, d, "customer").select(c.cast("long").alias("id"), parent.cast("long").alias("parent_id"))


class Canonical:
    """A case whose tables are projected from the plain ones: conversations as sessions, their turns as messages, every other one with a tool call and an observation."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    def table(self, name: str) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM ({CANONICAL[name][1]})", c=table(self.spark, self.d, "conversations"), r=table(self.spark, self.d, "region"))


# By table: its name in SQL, and the projection, which both engines read; {c} and {r} are conversations and region.
_ID = "(conv_id * 1000 + turn)"
CANONICAL = {
    "evidence_roots": ("k_roots", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS label, concat('/e/', r_regionkey) AS path, CASE WHEN r_regionkey % 2 = 0 THEN 'claude-code' ELSE 'cursor-ide' END AS harness FROM {r}"),
    "sessions": ("k_sessions", "SELECT DISTINCT conv_id AS id, conv_id % 5 AS root_id, concat('s', conv_id) AS harness_session_id, concat('title ', conv_id) AS title, CASE WHEN conv_id % 3 = 0 THEN 'subagent' ELSE 'primary' END AS kind, CASE WHEN conv_id % 2 = 0 THEN concat('/p/', conv_id % 7) END AS project_path, CASE WHEN conv_id % 4 <> 0 THEN concat('2024-01-01T00:00:0', conv_id % 10, '.000Z') END AS first_ts, CAST(NULL AS STRING) AS last_ts, CASE WHEN conv_id % 3 > 0 THEN conv_id - conv_id % 3 END AS parent_session_id, conv_id % 11 AS message_count, conv_id % 4 AS tool_call_count FROM {c}"),
    "provenance": ("k_records", f"SELECT {_ID} AS id, conv_id AS source_file_id, CAST(turn * 10 AS BIGINT) AS byte_offset, concat('h', {_ID}) AS content_sha256, CASE WHEN conv_id % 5 IN (1, 3) THEN concat('row ', {_ID}) END AS locator, CASE WHEN conv_id % 2 = 0 THEN 'transcript' ELSE 'history' END AS parser, CASE WHEN conv_id % 4 > 0 THEN '1' END AS parser_version FROM {{c}}"),
    "source_files": ("k_files", "SELECT DISTINCT conv_id AS id, concat('d/', conv_id, '.jsonl') AS rel_path, concat('f', conv_id) AS sha256, conv_id AS size, CAST(NULL AS STRING) AS mtime, conv_id % 5 AS root_id, conv_id % 2 AS store_id, 1 + conv_id % 2 AS version, CASE WHEN conv_id % 6 = 0 THEN 'symlink' ELSE 'file' END AS kind, CASE conv_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'inventoried' WHEN 2 THEN 'superseded' ELSE 'parsed' END AS parse_status, CASE WHEN conv_id % 4 = 0 THEN 'bad' END AS error FROM {c}"),
    "messages": ("k_messages", f"SELECT {_ID} AS id, conv_id AS session_id, {_ID} AS provenance_id, turn AS ordinal, role, concat('r-', role) AS record_type, CASE WHEN turn % 2 = 0 THEN concat('u', {_ID}) END AS uuid, CASE WHEN turn % 3 <> 0 THEN concat('2024-01-02T00:00:0', turn % 10, '.000Z') END AS timestamp, CASE WHEN turn % 3 <> 0 THEN 'stored' ELSE 'absent' END AS timestamp_origin, CASE WHEN role = 'assistant' THEN 'm1' END AS model FROM {{c}}"),
    "blocks": ("k_blocks", f"SELECT {_ID} * 2 AS id, {_ID} AS message_id, 0 AS ordinal, 'text' AS kind, text FROM {{c}} UNION ALL SELECT {_ID} * 2 + 1, {_ID}, 1, CASE WHEN turn % 2 = 1 THEN 'text' ELSE 'tool_use' END, CASE WHEN turn % 2 = 1 THEN 'more' END FROM {{c}}"),
    "tool_calls": ("k_calls", f"SELECT {_ID} AS id, conv_id AS session_id, 'Bash' AS name, 'shell' AS category, CASE WHEN conv_id % 2 = 0 THEN concat('{{{{\"command\":\"run ', conv_id, '\"}}}}') ELSE concat('plain ', text) END AS input, turn % 4 = 0 AS is_error, CASE WHEN turn % 4 = 2 THEN concat(text, ' [', text, ']') END AS result_text, {_ID} * 2 + 1 AS tool_use_block_id, CASE WHEN turn % 4 = 0 THEN ({_ID} + 1) * 2 END AS tool_result_block_id FROM {{c}} WHERE turn % 2 = 0"),
    "observations": ("k_seen", f"SELECT {_ID} AS id, conv_id AS session_id, 'command_executed' AS kind, CASE WHEN turn % 3 = 0 THEN {_ID} END AS derived_from_tool_call_id, CASE WHEN turn % 3 = 1 THEN {_ID} * 2 END AS derived_from_block_id, CASE WHEN turn % 3 = 2 THEN {_ID} END AS derived_from_provenance_id, CASE WHEN turn % 4 = 0 THEN concat('p', turn) END AS path, CASE WHEN conv_id % 2 = 0 THEN concat('c', turn) END AS command, 'high' AS confidence, CAST(NULL AS STRING) AS timestamp, 'absent' AS timestamp_origin FROM {{c}} WHERE turn % 2 = 0"),
    "anomalies": ("k_odd", f"SELECT {_ID} AS id, conv_id % 5 AS root_id, conv_id AS session_id, CASE turn % 3 WHEN 0 THEN 'malformed_record' WHEN 1 THEN 'unlinked_subagent' ELSE 'hash_drift' END AS kind, CASE turn % 2 WHEN 0 THEN 'warning' ELSE 'error' END AS severity, concat('odd ', turn) AS message FROM {{c}} WHERE turn % 5 = 0"),
    "annotations": ("k_notes", f"SELECT {_ID} AS id, CASE turn % 4 WHEN 0 THEN 'message' WHEN 1 THEN 'block' WHEN 2 THEN 'tool_call' ELSE 'session' END AS target_type, CASE turn % 4 WHEN 0 THEN {_ID} WHEN 1 THEN {_ID} * 2 WHEN 2 THEN {_ID} - 2 ELSE conv_id END AS target_id, CASE turn % 3 WHEN 0 THEN 'tag' WHEN 1 THEN 'bookmark' ELSE 'note' END AS kind, text AS value, '2024-01-01T00:00:00.000001Z' AS created_at, false AS deleted FROM {{c}} UNION ALL SELECT {_ID}, CASE turn % 4 WHEN 0 THEN 'message' WHEN 1 THEN 'block' WHEN 2 THEN 'tool_call' ELSE 'session' END, CASE turn % 4 WHEN 0 THEN {_ID} WHEN 1 THEN {_ID} * 2 WHEN 2 THEN {_ID} - 2 ELSE conv_id END, CASE turn % 3 WHEN 0 THEN 'tag' WHEN 1 THEN 'bookmark' ELSE 'note' END, text, '2024-01-02T00:00:00.000001Z', true FROM {{c}} WHERE conv_id % 3 = 0"),
    "stores": ("k_stores", "SELECT DISTINCT conv_id % 2 AS id, CAST(conv_id % 2 AS BIGINT) AS root_id, concat('kind', conv_id % 2) AS kind, concat('p', conv_id % 2) AS rel_path, 'parsed' AS status FROM {c}"),
    "absent_stores": ("k_absent", "SELECT DISTINCT conv_id % 5 AS root_id, concat('gone', turn % 3) AS kind FROM {c} WHERE conv_id % 5 < 3"),
    "audit_log": ("k_log", "SELECT DISTINCT conv_id AS id, 'ingest' AS action FROM {c}"),
}

TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
CTE = {
    "messages": "messages AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn AS ordinal, CASE WHEN role = 'system' THEN 'meta' ELSE role END AS role, text FROM conversations)",
    "files": "files AS (SELECT doc_id AS id, source AS root, lang AS store, source || '/' || lang || '/' || doc_id || '.txt' AS rel_path, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256, CAST(1 AS BIGINT) AS version, CASE lang WHEN 'en' THEN 'parsed' WHEN 'fr' THEN 'inventoried' WHEN 'de' THEN 'failed' ELSE 'unparsed' END AS parse_status, n_chars AS record_count, text FROM documents)",
    "observations": f"observations AS (SELECT event_id AS id, user_id AS session_id, CASE event_type WHEN 'view' THEN 'file_read' WHEN 'click' THEN 'command_executed' WHEN 'purchase' THEN 'file_written' WHEN 'signup' THEN 'upload_detected' ELSE 'anomaly' END AS kind, {TS} AS timestamp, props AS details, value FROM events)",
    "anomalies": "anomalies AS (SELECT event_id AS id, user_id AS session_id, 'malformed_record' AS kind, CASE WHEN value < 10 THEN 'info' WHEN value < 100 THEN 'warning' ELSE 'error' END AS severity, 'value of ' || (user_id % 7) AS message FROM events WHERE event_type = 'error')",
    "stream": "stream AS (SELECT user_id AS key, event_id AS position, CASE event_type WHEN 'click' THEN 'use' ELSE 'result' END AS kind FROM events WHERE event_type IN ('click', 'purchase'))",
    "records": "records AS (SELECT user_id AS stream, event_id AS position, 'assistant' AS role, event_type AS turn_key, event_type = 'error' AS hidden FROM events)",
    "forest": "forest AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 1000 <> 0 THEN c_custkey - 5 END WHEN c_custkey % 5 = 1 THEN c_custkey + 1 WHEN c_custkey % 5 = 2 THEN c_custkey - 1 WHEN c_custkey % 10 = 3 THEN c_custkey + 3 WHEN c_custkey % 10 = 8 THEN c_custkey - 2 ELSE c_custkey - 1 END AS BIGINT) AS parent_id FROM customer)",
}
CTE |= {name: f"{name} AS ({projection.format(c='conversations', r='region')})" for name, projection in CANONICAL.values()}


def sql(text: str) -> str:
    """text with the projections that it names in front."""
    import re

    used = [c for n, c in CTE.items() if re.search(rf"(?<!\.)\b{n}\b", text)]
    if text.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*used, text.removeprefix("WITH RECURSIVE ")])
    if text.startswith("WITH "):
        return "WITH " + ", ".join([*used, text.removeprefix("WITH ")])
    return ("WITH " + ", ".join(used) + " " if used else "") + text
