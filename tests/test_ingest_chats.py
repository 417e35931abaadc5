import hashlib
import json
import sqlite3

from sessionloom.functions import wire
from sessionloom.plans import ingest_agent
from sessionloom.sinks.case import Case


def name(n: int) -> str:
    return f"{n:02x}" * 32


def node(*to: int) -> bytes:
    return wire.encode([(1, bytes.fromhex(name(n))) for n in to] + [(2, 7)])


def store(path, head, blobs, drop=()):
    path.mkdir(parents=True)
    con = sqlite3.connect(path / "store.db")
    con.execute("CREATE TABLE meta (key TEXT, value TEXT)")
    con.executemany("INSERT INTO meta VALUES (?, ?)", head)
    con.execute("CREATE TABLE blobs (id TEXT, data BLOB)")
    con.executemany("INSERT INTO blobs VALUES (?, ?)", blobs)
    for table in drop:
        con.execute(f"DROP TABLE {table}")
    con.commit()
    con.close()


def test_chat_stores_become_sessions(spark, tmp_path):
    chats = tmp_path / "root/chats/w"
    said = lambda **x: json.dumps(x).encode()
    call = lambda i, tool, **args: {"type": "tool-call", "toolCallId": i, "toolName": tool, "args": args}
    result = lambda i, x: {"type": "tool-result", "toolCallId": i, "result": x}
    blobs = [
        (name(2), said(role="user", content="list the files", id="u")),
        (name(9), said(role="user", content=[{"type": "text", "text": "deleted"}])),
        (name(3), said(role="assistant", content=[{"type": "reasoning", "text": "hm"}, {"type": "text", "text": "so"}, call("c1", "run_terminal_cmd", command="ls"), call("c2", "read_file", path="/a"), call("c1", "edit_file", path="/b"), {"type": "odd"}], extra=1)),
        (name(1).upper(), node(2, 3, 1, 4, 5, 6, 7, 8)),
        (name(4), said(role="tool", content=[result("c1", "a.txt"), result("c9", {"x": 1})])),
        (name(5), said(role="user", content=[result("c2", {"k": "v"})])),
        (name(6), wire.encode([(1, b"workspace summary"), (2, wire.encode([(1, b"inner text"), (2, 3)]))])),
        (name(7), said(role="judge", content="?", z=2)),
        (name(8), b"[1, 2]"),
        (name(10), node(2)),
        (name(11), b"\x00\x01\x02\xff"),
    ]
    head = {"agentId": "agent", "latestRootBlobId": name(1), "name": "a title", "createdAt": 1767225600000, "lastUsedModel": "m1", "mode": "agent"}
    store(chats / "dir", [("0", "zz"), ("1", json.dumps(head).encode().hex())], blobs)
    store(chats / "empty", [], [])
    store(chats / "half", [], [], drop=["blobs"])
    store(chats / "lost", [("0", json.dumps({"latestRootBlobId": name(99)}).encode().hex())], [(name(2), said(role="user", content="hi")), (name(1), node(2))])
    (chats / "none").mkdir()
    (chats / "none/store.db").write_bytes(b"not a database at all")
    case = Case.create(spark, str(tmp_path / "case"), "c")
    ingest_agent.ingest(case, str(tmp_path / "root"), "r")
    table = {k: sorted(case.table(k).collect(), key=lambda r: r["id"]) for k in ("sessions", "messages", "blocks", "tool_calls", "observations", "identity_claims", "anomalies", "provenance", "source_files")}
    for k, rows in table.items():
        assert [r["id"] for r in rows] == list(range(1, len(rows) + 1)), k
    assert [(f.rel_path.split("/")[2], f.parse_status, f.record_count) for f in table["source_files"]] == [("dir", "parsed", 12), ("empty", "parsed", 0), ("half", "inventoried", None), ("lost", "parsed", 3), ("none", "inventoried", None)]
    s = table["sessions"]
    assert [(x.harness_session_id, x.title, x.first_ts if x.id == 1 else None, x.first_ts_origin, x.last_ts_origin, x.models, x.message_count, x.tool_call_count) for x in s] == [
        ("agent", "a title", "2026-01-01T00:00:00.000Z", "stored", "file_mtime", ["m1"], 6, 3), ("empty", None, None, "absent", "absent", [], 0, 0), ("lost", None, None, "file_mtime", "file_mtime", [], 1, 0),
    ]
    m = [(r.role, r.record_type, r.uuid[:2] if len(r.uuid) > 2 else r.uuid, json.loads(r.attributes)) for r in table["messages"] if r.session_id == 1]
    assert m == [
        ("meta", "meta", "1", {**head, "tree_nodes": 2}),
        ("user", "blob", "02", {"id": "u"}), ("assistant", "blob", "03", {"extra": 1, "turn": "agent:2"}), ("tool", "blob", "04", {"turn": "agent:2"}),
        ("user", "blob", "05", {}), ("tool", "blob.tool-result", "05", {"turn": "agent:5"}),
        ("meta", "protobuf", "06", {"confidence": "low", "record_type": "protobuf"}), ("meta", "blob", "07", {"role": "judge", "z": 2}), ("meta", "json", "08", {}),
        ("user", "blob", "09", {}), ("meta", "protobuf", "0b", {"confidence": "low", "record_type": "protobuf"}),
    ]
    texts = {r.uuid[:2] + r.record_type[4:]: [(b.kind, b.text) for b in table["blocks"] if b.message_id == r.id] for r in table["messages"] if r.session_id == 1}
    assert texts["03"] == [("thinking", "hm"), ("text", "so"), ("tool_use", None), ("tool_use", None), ("tool_use", None), ("other", None)]
    assert texts["04"] == [("tool_result", "a.txt"), ("tool_result", '{"x":1}')] and texts["05"] == [] and texts["05.tool-result"] == [("tool_result", '{"k":"v"}')]
    assert texts["06obuf"] == [("text", "workspace summary\ninner text")] and texts["0bobuf"] == [("other", None)] and texts["08"] == [("other", None)]
    assert [json.loads(b.payload) for b in table["blocks"] if b.kind == "other"] == [{"type": "odd"}, [1, 2], {"bytes": 4}]
    assert [(c.name, c.category, json.loads(c.input), c.result_text) for c in table["tool_calls"]] == [("run_terminal_cmd", "shell", {"command": "ls"}, None), ("edit_file", "file_edit", {"path": "/b"}, "a.txt"), ("read_file", "file_read", {"path": "/a"}, '{"k":"v"}')]
    assert [(o.kind, o.path, o.command, o.confidence) for o in table["observations"]] == [("command_executed", None, "ls", "medium"), ("file_edited", "/b", None, "high"), ("file_read", "/a", None, "high")]
    assert [(c.session_id, c.scheme, c.claimed_id) for c in table["identity_claims"]] == [(1, "cursor:composerId", "agent"), (1, "cursor:store-session", "dir"), (2, "cursor:store-session", "empty"), (3, "cursor:store-session", "lost")]
    odd = sorted((a.source_file_id, a.kind, a.severity, a.provenance_id is not None) for a in table["anomalies"])
    assert odd == sorted([
        (1, "malformed_record", "error", False), (1, "unknown_field", "info", True), (1, "unknown_field", "info", True), (1, "unknown_record_type", "info", True), (1, "unknown_record_type", "info", True),
        (1, "unpaired_tool_result", "warning", True), (1, "unreferenced_record", "info", True), (1, "unreferenced_record", "info", True), (1, "unreferenced_record", "info", True),
        (3, "unknown_store_generation", "info", False), (4, "missing_transcript", "info", False), (5, "unknown_store_generation", "info", False),
    ])
    p = table["provenance"]
    assert [(x.locator[:8], x.origin) for x in p if x.source_file_id == 1][:2] == [("meta:1", "stored"), ("blobs:02", "stored")] and {x.locator[6:8] for x in p if x.origin == "derived"} == {"06", "0b"}
    kept = {r.sha256 for r in case.table("blobs").collect()}
    assert kept == {x.content_sha256 for x in p} and hashlib.sha256(node(2)).hexdigest() in kept and hashlib.sha256(node(2, 3, 1, 4, 5, 6, 7, 8)).hexdigest() not in kept
