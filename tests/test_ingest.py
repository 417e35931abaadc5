import hashlib
import json

from sessionloom.operators import api
from sessionloom.plans import ingest
from sessionloom.sinks.case import Case

AT = "2026-01-02T03:04:0{}.000Z"


def lines(*records, tail=""):
    return "\n".join(json.dumps(r, ensure_ascii=False) for r in records) + "\n" + tail


def write(root, rel, content):
    p = root / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(content)


def plant(root):
    use = {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "/w/z", "old_string": "a", "new_string": "b"}}
    spawn = {"type": "tool_use", "id": "t2", "name": "Task", "input": {"subagent_type": "x", "prompt": "né"}}
    write(root, "projects/-w/s1.jsonl", lines(
        {"type": "user", "uuid": "u1", "sessionId": "s1", "cwd": "/w", "timestamp": AT.format(1), "message": {"role": "user", "content": "say token = abcdefghij"}},
        {"type": "assistant", "sessionId": "s1", "timestamp": AT.format(2), "message": {"id": "m", "model": "m1", "content": [{"type": "text", "text": "hi"}, use, spawn]}},
        {"type": "user", "sessionId": "s1", "timestamp": AT.format(3), "toolUseResult": {"filePath": "/w/z", "oldString": "A", "zz": 1, "aa": 2}, "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "done"}]}},
        {"type": "attachment", "sessionId": "s1", "attachment": {"content": "pinned"}},
        {"type": "file-history-delta", "trackingPath": "z", "backup": {"backupFileName": "z@v1", "realParentDir": "/w", "backupTime": AT.format(4)}},
        {"type": "custom-title", "customTitle": "T", "sessionId": "s1"}, tail='{"type":"us'))
    write(root, "projects/-w/s1/subagents/agent-a.jsonl", lines({"type": "user", "sessionId": "s1", "timestamp": AT.format(5), "message": {"content": "go"}}))
    write(root, "projects/-w/s1/subagents/agent-a.meta.json", json.dumps({"description": "Helper", "toolUseId": "t2"}))
    write(root, "projects/-w/s1/subagents/agent-b.meta.json", json.dumps({"description": "Lost"}))
    write(root, "projects/-w/lost/subagents/agent-c.jsonl", lines({"type": "assistant", "message": {"content": [{"type": "tool_result", "tool_use_id": "no", "content": "x"}]}}))
    write(root, "projects/-w/s2.jsonl.orphaned-1", lines({"type": "user", "sessionId": "s2", "session_id": "s1", "timestamp": AT.format(6), "message": {"content": [{"type": "text", "text": "more"}]}}))
    write(root, "history.jsonl", lines(
        {"display": "old", "timestamp": 1767225600000, "project": "/p", "sessionId": "s9", "pastedContents": {"1": {"id": 1, "content": "password: hunter2hunter2"}, "2": {"contentHash": "abc"}, "3": {"contentHash": "../x"}}},
        {"display": "again", "timestamp": 1767225601000, "sessionId": "s9", "pastedContents": {}}, {"display": "known", "timestamp": 1767225602000, "sessionId": "s1"}, {"display": "nobody"}))
    write(root, "paste-cache/abc.txt", "cached")
    write(root, "file-history/s1/z@v1", "A")
    write(root, "uploads/s8/r.pdf", "%PDF-1")
    (root / "projects/-w/link").symlink_to("s1.jsonl")


def test_a_directory_becomes_a_case(spark, tmp_path):
    root = tmp_path / "root"
    plant(root)
    case = Case.create(spark, str(tmp_path / "case"), "c")
    n = ingest.ingest(case, str(root), "r")
    table = {k: {r["id"]: r for r in case.table(k).collect()} for k in ("source_files", "stores", "sessions", "messages", "blocks", "tool_calls", "observations", "identity_claims", "anomalies", "provenance")}
    for k, rows in table.items():
        assert sorted(rows) == list(range(1, len(rows) + 1)), k
    files = sorted(table["source_files"].values(), key=lambda r: r.id)
    assert [(r.rel_path, r.parse_status, r.record_count) for r in files] == [
        ("projects/-w/link", "inventoried", None), ("projects/-w/lost/subagents/agent-c.jsonl", "parsed", 1), ("projects/-w/s1.jsonl", "parsed", 7), ("projects/-w/s1/subagents/agent-a.jsonl", "parsed", 1), ("projects/-w/s1/subagents/agent-a.meta.json", "parsed", 1), ("projects/-w/s1/subagents/agent-b.meta.json", "parsed", 1),
        ("projects/-w/s2.jsonl.orphaned-1", "parsed", 1), ("history.jsonl", "parsed", 4), ("file-history/s1/z@v1", "inventoried", None), ("paste-cache/abc.txt", "inventoried", None), ("uploads/s8/r.pdf", "parsed", 1),
    ]
    assert {r.kind for r in case.table("absent_stores").collect()} == {"claude:shell-snapshots", "claude:todos", "claude:plans", "claude:settings"}
    by = {r.harness_session_id: r for r in table["sessions"].values()}
    assert {k: (r.kind, r.title, r.message_count, r.tool_call_count) for k, r in by.items()} == {"agent-c": ("subagent", None, 1, 0), "s1": ("primary", "T", 3, 2), "agent-a": ("subagent", "Helper", 1, 0), "s2": ("resumed", None, 1, 0), "s9": ("sidecar_only", None, 2, 0), "s8": ("sidecar_only", None, 0, 0)}
    assert by["agent-a"].parent_session_id == by["s1"].id and by["s1"].project_path == "/w" and by["s9"].project_path == "/p" and by["s1"].models == ["m1"]
    assert (by["s1"].first_ts, by["s1"].last_ts, by["s1"].first_ts_origin) == (AT.format(1), AT.format(3), "stored") and by["agent-c"].first_ts_origin == "file_mtime"
    m = api.messages(case, by["s1"].id, meta=True).collect()
    assert [(x.ordinal, x.role, [b.kind for b in x.blocks or []]) for x in m] == [(0, "user", ["text"]), (1, "assistant", ["text", "tool_use", "tool_use"]), (2, "tool", ["tool_result"]), (3, "meta", ["attachment"]), (4, "meta", []), (5, "meta", [])]
    assert json.loads(m[1].attributes)["message"] == {"id": "m", "model": "m1"} and "toolUseResult" not in m[2].attributes
    calls = sorted(table["tool_calls"].values(), key=lambda r: r.id)
    assert [(c.name, c.result_text, c.tool_result_block_id is None) for c in calls] == [("Edit", "done", False), ("Task", None, True)]
    assert json.loads(calls[0].input) == {"file_path": "/w/z", "old_string": "a", "new_string": "b"} and list(json.loads(calls[0].result_payload)) == ["filePath", "oldString", "zz", "aa"]
    assert {b.tool_call_id for b in table["blocks"].values() if b.kind in ("tool_use", "tool_result") and b.message_id in {x.id for x in m}} == {1, 2}
    o = sorted(((r.kind, r.path, r.confidence, r.timestamp_origin) for r in table["observations"].values()), key=str)
    assert o == sorted([("file_edited", "/w/z", "high", "stored"), ("subagent_spawned", None, "high", "stored"), ("file_edited", "/w/z", "medium", "stored"), ("paste_detected", None, "high", "stored"), ("upload_detected", "r.pdf", "high", "file_mtime"), ("secret_candidate", None, "low", "stored"), ("secret_candidate", None, "low", "stored")], key=str)
    edit = next(r for r in table["observations"].values() if r.kind == "file_edited" and r.confidence == "high")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (edit.before_blob, edit.after_blob) == (sha("A"), sha("b")) and edit.derived_from_tool_call_id == 1
    paste = next(json.loads(r.details) for r in table["observations"].values() if r.kind == "paste_detected")
    assert [(p["inline"], p["missing"], p["content_blob"]) for p in paste["pastes"]] == [(True, False, None), (False, False, sha("cached")), (False, True, None)]
    claims = sorted((c.scheme, c.claimed_id, c.join_status) for c in table["identity_claims"].values())
    assert claims == [("claude:origin_session_id", "s1", "matched"), ("claude:sessionId", "s1", "matched"), ("claude:sessionId", "s1", "matched"), ("claude:sessionId", "s2", "matched"), ("claude:spawning_tool_use_id", "t2", "matched")]
    odd = sorted((a.kind, a.severity) for a in table["anomalies"].values())
    assert odd == sorted([("truncated_line", "warning"), ("missing_timestamp", "warning"), ("unpaired_tool_result", "warning"), ("orphaned_file", "info"), ("malformed_record", "info"), ("missing_transcript", "warning"), ("missing_transcript", "warning"), ("missing_transcript", "warning"), ("suspicious_path", "warning"), ("symlink_in_evidence", "info"), ("unlinked_subagent", "warning")])
    for p in table["provenance"].values():
        data = (root / table["source_files"][p.source_file_id].rel_path).read_bytes()
        assert hashlib.sha256(data[p.byte_offset : p.byte_offset + p.byte_length]).hexdigest() == p.content_sha256
    assert {r.sha256 for r in case.table("blobs").collect()} == {sha(x) for x in ("A", "b", "cached", "%PDF-1")}
    assert [r.kind for r in api.search(case, "more").collect()] == ["block"]

    assert ingest.ingest(case, str(root), "r") == n and case.table("messages").count() == len(table["messages"])
    write(root, "projects/-w/s3.jsonl", lines({"type": "user", "sessionId": "s3", "timestamp": AT.format(7), "message": {"content": "new"}}))
    write(root, "projects/-w/lost.jsonl", lines({"type": "user", "sessionId": "lost", "timestamp": AT.format(8), "message": {"content": "found"}}))
    write(root, "paste-cache/abc.txt", "changed")
    ingest.ingest(case, str(root), "r")
    by = {r.harness_session_id: r for r in case.table("sessions").collect()}
    assert len(by) == 8 and by["agent-c"].parent_session_id == by["lost"].id and by["s1"].message_count == 3
    assert sorted((r.version, r.parse_status) for r in case.table("source_files").where("rel_path like 'paste%'").collect()) == [(1, "superseded"), (2, "inventoried")]
    assert case.table("anomalies").where("kind = 'hash_drift'").count() == 1
