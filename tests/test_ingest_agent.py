import hashlib
import json

from sessionloom.plans import ingest_agent
from sessionloom.sinks.case import Case


def test_an_agents_directory_becomes_a_case(spark, tmp_path):
    root = tmp_path / "root"
    home = root / "projects/home-p/agent-transcripts"
    (home / "s1/subagents").mkdir(parents=True)
    (home / "s1/agent-tools").mkdir()
    use = lambda **x: {"type": "tool_use", **x}
    lines = [
        {"role": "assistant", "message": {"content": [{"type": "text", "text": "early"}]}},
        {"role": "user", "message": {"content": [{"type": "text", "text": "<timestamp>Friday, Jan 2, 2026, 3:04 PM (UTC+1)</timestamp>\n<user_query>\nwhy\n</user_query>"}]}},
        {"role": "assistant", "message": {"id": "m", "model": "x", "content": [use(id="t1", name="Shell", input={"command": "ls"}), use(name="Read", input={"path": "/a"}), use(id="t2", name="Write", input={"path": "/b", "content": "password = abcdefghij"})]}},
        {"role": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "out"}, {"type": "tool_result", "tool_use_id": "t9", "content": "?"}]}},
        {"role": "judge", "message": {"content": [{"type": "odd"}]}, "z": 1},
    ]
    (home / "s1/s1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n[1]\n{bad\n{cut")
    (home / "s1/subagents/s2.jsonl").write_text('{"role":"user","message":{"content":"go"}}\n')
    (home / "s1/agent-tools/t2.txt").write_text("side")
    case = Case.create(spark, str(tmp_path / "case"), "c")
    ingest_agent.ingest(case, str(root), "r")
    table = {k: sorted(case.table(k).collect(), key=lambda r: r["id"]) for k in ("sessions", "messages", "blocks", "tool_calls", "observations", "identity_claims", "anomalies", "provenance")}
    for k, rows in table.items():
        assert [r["id"] for r in rows] == list(range(1, len(rows) + 1)), k
    s1, s2 = table["sessions"]
    assert (s1.harness_session_id, s1.kind, s1.project_path, s1.first_ts, s1.first_ts_origin, s1.last_ts_origin, s1.message_count, s1.models) == ("s1", "primary", "home-p", None, "absent", "file_mtime", 4, ["x"])
    assert (s2.harness_session_id, s2.kind, s2.parent_session_id) == ("s2", "subagent", s1.id)
    m = [(r.role, r.record_type, json.loads(r.attributes)) for r in table["messages"] if r.session_id == s1.id]
    assert m == [
        ("assistant", "assistant", {"turn": "s1:none"}), ("user", "user", {"user_query": {"text": "why", "embedded_timestamp": "Friday, Jan 2, 2026, 3:04 PM (UTC+1)", "embedded_timestamp_utc": "2026-01-02T14:04:00.000Z"}}),
        ("assistant", "assistant", {"message": {"id": "m", "model": "x"}, "turn": "s1:1"}), ("tool", "user", {"turn": "s1:1"}), ("meta", "judge", {"role": "judge", "z": 1}),
    ]
    assert [(c.name, c.category, c.result_text, c.result_payload and json.loads(c.result_payload)) for c in table["tool_calls"]] == [("Read", "file_read", None, None), ("Shell", "shell", "out", None), ("Write", "file_write", None, {"sidecar_blob": hashlib.sha256(b"side").hexdigest()})]
    assert sorted((o.kind, o.path, o.command, o.confidence) for o in table["observations"] if o.kind != "command_executed") == [("file_read", "/a", None, "medium"), ("file_written", "/b", None, "medium"), ("secret_candidate", None, None, "low")]
    assert [(o.command, o.confidence) for o in table["observations"] if o.kind == "command_executed"] == [("ls", "high")]
    odd = sorted((a.kind, a.severity) for a in table["anomalies"])
    assert odd == [("malformed_record", "error"), ("malformed_record", "error"), ("truncated_line", "warning"), ("unknown_record_type", "info"), ("unknown_record_type", "info"), ("unknown_record_type", "warning"), ("unpaired_tool_result", "warning")]
    assert [r.sha256 for r in case.table("blobs").collect()] == [hashlib.sha256(b"side").hexdigest()] and {c.scheme for c in table["identity_claims"]} == {"cursor:composerId"}
