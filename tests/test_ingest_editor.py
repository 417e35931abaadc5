import hashlib
import json
import sqlite3

from sessionloom.operators import api
from sessionloom.plans import ingest_editor
from sessionloom.sinks.case import Case


def store(path, table, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    con = sqlite3.connect(path)
    con.execute(f"CREATE TABLE {table} (key TEXT PRIMARY KEY, value BLOB)")
    con.executemany(f"INSERT INTO {table} VALUES (?, ?)", [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in rows])
    con.commit()
    con.close()


def plant(root):
    store(root / "User/globalStorage/state.vscdb", "cursorDiskKV", [
        ("composerData:c1", {"_v": 3, "name": "N", "createdAt": 1767225600000, "lastUpdatedAt": 1767225700000, "fullConversationHeadersOnly": [{"bubbleId": "b2", "type": 1}, {"bubbleId": "b9", "type": 2}, {"bubbleId": "b1", "type": 2}, {"bubbleId": "b2", "type": 1}]}),
        ("bubbleId:c1:b1", {"type": 2, "text": "done", "zeta": 1, "alpha": 2, "thinking": {"text": "hm"}, "modelInfo": {"modelName": "m"}, "createdAt": "2026-01-01T00:00:05Z", "toolFormerData": {"name": "run_terminal_cmd_v2", "toolCallId": "k", "rawArgs": '{"command":"ls"}', "status": "completed", "result": {"out": "x"}}}),
        ("bubbleId:c1:b2", {"type": 1, "text": "ask token = abcdefghij", "createdAt": "2026-01-01T00:00:01Z", "images": [{"a": 1}]}), ("bubbleId:c1:b3", {"type": 2, "text": "cut"}), ("bubbleId:c1:b4", "{no"),
        ("composerData:c2", {"conversation": [{"bubbleId": "i1", "type": 1, "text": "old"}, 7]}), ("bubbleId:o1:b1", {"type": 2, "toolFormerData": {"name": "delete_file", "rawArgs": "{bad"}}), ("bubbleId:x", {}), ("checkpointId:1", {}),
    ])
    store(root / "User/workspaceStorage/w1/state.vscdb", "ItemTable", [("composer.composerData", {"allComposers": [{"composerId": "c1"}, {"composerId": "zz"}]}), ("else", "1")])
    (root / "User/workspaceStorage/w1/workspace.json").write_text('{"folder": "file:///home/p"}')
    h = root / "User/History/h1"
    h.mkdir(parents=True)
    (h / "entries.json").write_text('{"version": 1, "resource": "file:///home/p/é.py", "entries": [{"id": "A.py", "timestamp": 1767225600000}, 7, {"id": "gone", "timestamp": 1767225601000}, {"id": "B.py", "timestamp": 1767225602000, "source": "s", "x": 1}]}')
    (h / "A.py").write_text("a")
    (h / "B.py").write_text("b")


def test_an_editors_directory_becomes_a_case(spark, tmp_path):
    root = tmp_path / "root"
    plant(root)
    case = Case.create(spark, str(tmp_path / "case"), "c")
    ingest_editor.ingest(case, str(root), "r")
    table = {k: {r["id"]: r for r in case.table(k).collect()} for k in ("source_files", "stores", "sessions", "messages", "blocks", "tool_calls", "observations", "identity_claims", "anomalies", "provenance")}
    for k, rows in table.items():
        assert sorted(rows) == list(range(1, len(rows) + 1)), k
    by = {r.harness_session_id: r for r in table["sessions"].values()}
    assert {k: (r.kind, r.title, r.message_count, r.tool_call_count, r.project_path) for k, r in by.items()} == {"c1": ("primary", "N", 4, 1, "/home/p"), "c2": ("primary", None, 1, 0, None), "o1": ("sidecar_only", None, 1, 1, None), "history:h1": ("local_history", "/home/p/é.py", 0, 0, None)}
    assert (by["c1"].first_ts, by["c1"].last_ts, by["c1"].models) == ("2026-01-01T00:00:00.000Z", "2026-01-01T00:01:40.000Z", ["m"])
    m = api.messages(case, by["c1"].id, meta=True).collect()
    assert [(x.ordinal, x.role, x.uuid, [b.kind for b in x.blocks or []]) for x in m] == [(0, "meta", "c1", []), (1, "user", "b2", ["text", "image"]), (2, "assistant", "b1", ["thinking", "text", "tool_use"]), (3, "tool", "b1", ["tool_result"]), (4, "assistant", "b3", ["text"])]
    assert [x.turn_key for x in m] == [None, None, "c1:0", "c1:0", "c1:0"] and list(json.loads(m[2].attributes)) == ["type", "zeta", "alpha", "modelInfo", "createdAt", "turn"]
    assert json.loads(m[0].attributes) == {"_v": 3, "name": "N", "createdAt": 1767225600000, "lastUpdatedAt": 1767225700000}
    calls = sorted(table["tool_calls"].values(), key=lambda r: r.id)
    assert [(c.name, c.category, c.input, c.result_text, c.is_error) for c in calls] == [("run_terminal_cmd_v2", "shell", '{"command":"ls"}', '{"out":"x"}', False), ("delete_file", "file_edit", '{"raw":"{bad"}', None, False)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    o = sorted(((r.kind, r.path, r.command, r.confidence, r.before_blob, r.after_blob) for r in table["observations"].values()), key=str)
    assert o == sorted([("command_executed", None, "ls", "high", None, None), ("file_deleted", None, None, "medium", None, None), ("secret_candidate", None, None, "low", None, None), ("file_written", "/home/p/é.py", None, "high", None, sha("a")), ("file_written", "/home/p/é.py", None, "high", sha("a"), None), ("file_written", "/home/p/é.py", None, "high", None, sha("b"))], key=str)
    data = (root / "User/History/h1/entries.json").read_bytes()
    for p in table["provenance"].values():
        if p.parser == "cursor-history":
            assert sha(data[p.byte_offset : p.byte_offset + p.byte_length].decode()) == p.content_sha256
    assert {p.locator for p in table["provenance"].values() if p.locator} == {f"cursorDiskKV:{k}" for k in ("composerData:c1", "composerData:c2", "composerData:c2#conversation[0]", "composerData:c2#conversation[1]", "bubbleId:c1:b1", "bubbleId:c1:b2", "bubbleId:c1:b3", "bubbleId:c1:b4", "bubbleId:o1:b1")}
    odd = sorted(((a.kind, a.severity, json.loads(a.details)) for a in table["anomalies"].values() if a.kind == "unknown_field"), key=str)
    assert [d["field"] for *_, d in odd] == ["alpha", "zeta"]
    kinds = sorted((a.kind, a.severity) for a in table["anomalies"].values() if a.kind != "unknown_field")
    assert kinds == sorted([("missing_transcript", "info"), ("unreferenced_record", "info"), ("unreferenced_record", "info"), ("malformed_record", "error"), ("malformed_record", "error"), ("malformed_record", "error"), ("missing_timestamp", "warning"), ("missing_timestamp", "warning"), ("missing_timestamp", "warning"), ("malformed_record", "info"), ("malformed_record", "warning"), ("missing_transcript", "warning"), ("unknown_record_type", "info"), ("missing_transcript", "info"), ("missing_transcript", "info")])
    assert {c.join_status for c in table["identity_claims"].values()} == {"unmatched"} and len(table["identity_claims"]) == 3

    other = tmp_path / "other"
    store(other / "User/globalStorage/state.vscdb", "cursorDiskKV", [("composerData:c1", {"name": "copy"})])
    ingest_editor.ingest(case, str(other), "o")
    assert sorted((c.claimed_id, c.join_status) for c in case.table("identity_claims").collect()) == [("c1", "matched"), ("c1", "matched"), ("c2", "unmatched"), ("o1", "unmatched")]
