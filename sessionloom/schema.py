"""The canonical tables and the domains of their enumerations."""

from pyspark.sql.types import StructType, _parse_datatype_string

# The tables that a case consists of.
TABLES = {
    "case_info": "case_id string, name string, examiner string, created_at string, schema_version int, tool_version string",
    "evidence_roots": "id bigint, label string, path string, harness string, identification string, retained boolean, added_at string",
    "stores": "id bigint, root_id bigint, kind string, rel_path string, generation string, status string",
    "absent_stores": "root_id bigint, kind string",
    "source_files": "id bigint, root_id bigint, store_id bigint, rel_path string, encoded boolean, version bigint, kind string, size bigint, sha256 string, mtime string, ctime string, btime string, atime string, parse_status string, record_count bigint, error string",
    "sessions": "id bigint, store_id bigint, root_id bigint, harness_session_id string, parent_session_id bigint, parent_harness_session_id string, kind string, title string, project_path string, models array<string>, first_ts string, first_ts_origin string, last_ts string, last_ts_origin string, bounds_from_adapter boolean, message_count bigint, tool_call_count bigint",
    "provenance": "id bigint, source_file_id bigint, byte_offset bigint, byte_length bigint, locator string, content_sha256 string, parser string, parser_version string, origin string",
    "messages": "id bigint, session_id bigint, provenance_id bigint, ordinal bigint, role string, record_type string, uuid string, parent_uuid string, timestamp string, timestamp_origin string, model string, attributes string",
    "blocks": "id bigint, message_id bigint, ordinal bigint, kind string, text string, payload string, tool_use_id string, tool_call_id bigint",
    "tool_calls": "id bigint, session_id bigint, name string, category string, input string, result_text string, result_payload string, is_error boolean, tool_use_block_id bigint, tool_result_block_id bigint",
    "observations": "id bigint, session_id bigint, kind string, derived_from_block_id bigint, derived_from_tool_call_id bigint, derived_from_provenance_id bigint, path string, command string, before_blob string, after_blob string, timestamp string, timestamp_origin string, confidence string, details string",
    "identity_claims": "id bigint, session_id bigint, scheme string, claimed_id string, join_status string",
    "anomalies": "id bigint, root_id bigint, source_file_id bigint, session_id bigint, provenance_id bigint, kind string, severity string, message string, details string",
    "blobs": "sha256 string, size bigint",
    "blob_contents": "sha256 string, at bigint, content binary",
    "annotations": "id bigint, target_type string, target_id bigint, kind string, value string, created_at string, deleted boolean",
    "audit_log": "id bigint, at string, action string, details string",
}

# The members of each enumeration.
ENUMS = {
    "harness": "claude-code codex cursor cursor-ide",
    "ts_origin": "stored stored_local_clock file_mtime neighbor_interpolated absent",
    "role": "user assistant system tool meta",
    "block_kind": "text thinking tool_use tool_result image attachment other",
    "tool_category": "shell file_read file_write file_edit search web agent mcp other",
    "observation_kind": "command_executed file_read file_written file_edited file_deleted subagent_spawned url_referenced secret_candidate paste_detected upload_detected",
    "confidence": "high medium low",
    "session_kind": "primary subagent resumed forked sidecar_only local_history",
    "join_status": "matched unmatched ambiguous",
    "severity": "info warning error",
    "provenance_origin": "stored derived inferred",
}


def schema(table: str) -> StructType:
    return _parse_datatype_string(TABLES[table])
