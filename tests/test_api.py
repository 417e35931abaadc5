import hashlib
import json

import pytest

from sessionloom.operators import api
from sessionloom.schema import schema
from sessionloom.sinks import timeline as sink
from sessionloom.sources import editor


class Frames:
    def __init__(self, spark, **rows):
        self.spark, self.rows = spark, rows

    def table(self, name):
        s = schema(name)
        return self.spark.createDataFrame([[r.get(f.name) for f in s.fields] for r in self.rows.get(name, [])], s)


def test_questions(spark, tmp_path):
    case = Frames(
        spark,
        case_info=[{"case_id": "c"}],
        evidence_roots=[{"id": 1, "harness": "claude-code", "label": "r"}, {"id": 2, "harness": "cursor"}],
        stores=[{"id": 1, "root_id": 1}, {"id": 2, "root_id": 1}],
        source_files=[{"id": 1, "root_id": 1, "store_id": 1, "rel_path": "a", "parse_status": "parsed", "record_count": 3}, {"id": 2, "root_id": 1, "store_id": 1, "rel_path": "b", "parse_status": "failed"}],
        sessions=[{"id": 1, "root_id": 1, "title": "T", "project_path": "/Home/x_y", "first_ts": "2026-01-02T00:00:00.000Z"}, {"id": 2, "root_id": 1, "parent_session_id": 1}, {"id": 3, "root_id": 2, "project_path": "/home/xzy"}],
        messages=[{"id": 1, "session_id": 1, "provenance_id": 7, "ordinal": 0, "role": "user", "attributes": "{}"}, {"id": 2, "session_id": 1, "ordinal": 1, "role": "assistant", "attributes": '{"requestId":"r"}'}, {"id": 3, "session_id": 1, "ordinal": 2, "role": "meta"}],
        blocks=[{"id": 1, "message_id": 1, "ordinal": 0, "kind": "text", "text": "Hello big world"}, {"id": 2, "message_id": 2, "ordinal": 0, "kind": "tool_use", "tool_call_id": 1}],
        tool_calls=[{"id": 1, "session_id": 1, "name": "Bash", "input": "ls big world", "tool_use_block_id": 2}],
        observations=[{"id": 1, "session_id": 1, "kind": "command_executed", "derived_from_tool_call_id": 1}, {"id": 2, "session_id": 1, "kind": "file_read", "derived_from_provenance_id": 7, "timestamp": "t"}],
        anomalies=[{"id": 1, "root_id": 1, "session_id": 2, "kind": "k", "severity": "error"}],
        provenance=[{"id": 7, "source_file_id": 1}],
    )
    assert api.case_info(case).first()["n_messages"] == 2
    assert [(r.id, r.files, r.parsed, r.records) for r in api.roots(case).collect()] == [(1, 2, 1, 3), (2, 0, 0, 0)]
    assert [(r.id, r.files) for r in api.stores(case, 1).collect()] == [(1, 2), (2, 0)]
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(api.sessions(case)) == [1, 3, 2] and ids(api.sessions(case, project="HOME/X_Y")) == [1] and ids(api.sessions(case, harness="cursor")) == [3]
    assert ids(api.sessions(case, has_children=True)) == [1] and ids(api.sessions(case, has_anomalies=True)) == [2] and ids(api.sessions(case, since="2026-01-02")) == [1]
    assert ids(api.children(case, 1)) == [2] and ids(api.anomalies(case, severity="error", root_id=1)) == [1] and ids(api.files(case, 1)) == [1, 2]
    assert [(r.id, r.content_class, r.turn_key) for r in api.messages(case, 1).collect()] == [(1, "prompt", None), (2, "assistant", "|r")] and len(ids(api.messages(case, 1, meta=True))) == 3
    assert ids(api.tool_calls_of_message(case, 2)) == [1] and ids(api.observations(case, 1)) == [1, 2]
    assert [(r.message_id, r.title) for r in api.activity_page(case, "commands").collect()] == [(2, "T")] and api.activity_page(case, "files").first().message_id == 1
    assert api.provenance(case, 7).first().label == "r"
    assert sorted((r.kind, r.message_id) for r in api.search(case, 'BIG "world"').collect()) == [("block", 1), ("tool_call", 2)] and api.search(case, " ").count() == 0
    case.path = str(tmp_path)
    api.keep_index(case)
    columns = ["kind", "block_id", "message_id", "session_id", "tool_call_id", "snippet", "title", "ordinal", "score"]
    one, two = (api.search(case, "big World", kept=k).select(columns).collect() for k in (False, True))
    assert one == two and [(r.kind, r.block_id, r.tool_call_id) for r in one if r.kind == "tool_call"] == [("tool_call", 2, 1)] and {r.snippet for r in one} >= {"ls [big world]"}
    assert [(r.session_id, r.hits) for r in api.grouped_hits(api.search(case, "big world")).collect()] == [(1, 2)] and api.search(case, "nowhere", kept=True).count() == 0


def test_editor_store(spark):
    j = lambda k, **v: (k, bytearray(json.dumps(v).encode()))
    kv = spark.createDataFrame([
        j("composerData:c", name="N", createdAt=1767225600000, fullConversationHeadersOnly=[{"bubbleId": "b2", "type": 1}, {"bubbleId": "b9", "type": 2}, {"bubbleId": "b1", "type": 2}, {"bubbleId": "b2", "type": 1}]),
        j("bubbleId:c:b1", type=2, text="x", toolFormerData={"name": "run_terminal_cmd_v2", "rawArgs": '{"command":"ls"}', "status": "completed"}), j("bubbleId:c:b2", type=1, text="q", createdAt="2026-01-01T00:00:00Z"), j("bubbleId:c:b3", type=2), j("bubbleId:o:b1", type=1),
    ], "key string, value binary")
    assert editor.composers(kv).first().created == "2026-01-01T00:00:00.000Z"
    assert [(r["item"], r.state) for r in editor.conversation(kv).orderBy("position").collect()] == [("b2", "present"), ("b9", "missing"), ("b1", "present"), ("b3", "unreferenced")]
    assert [r.composer for r in editor.orphans(kv).collect()] == ["o"]
    assert [(r.kind, r.command, r.confidence) for r in editor.tool_observations(editor.bubbles(kv)).collect()] == [("command_executed", "ls", "high")]
    assert {r.composer: r.n for r in editor.missing_times(kv).collect()} == {"c": 2, "o": 1}
    docs = spark.createDataFrame([("w", '{"folder":"file:///c%3A/a+b"}')], "workspace string, doc string")
    assert editor.workspaces(docs).first().project_path in ("c:/a+b", "C:/a+b")
    h = spark.createDataFrame([('{"resource":"file:///p","entries":[{"id":"1","timestamp":0},7,{"id":"2","timestamp":1000,"source":"s"}]}',)], "doc string")
    assert [(r.position, r.id, r.timestamp) for r in editor.history(h).orderBy("position").collect()] == [(0, "1", "1970-01-01T00:00:00.000Z"), (2, "2", "1970-01-01T00:00:01.000Z")]


def _small_case(spark, tmp_path):
    from sessionloom.sinks.case import Case

    home = tmp_path / "home"
    (home / "d").mkdir(parents=True)
    (home / "d/a.jsonl").write_text("x\n")
    (home / "l").symlink_to("d/a.jsonl")
    case = Case.create(spark, str(tmp_path / "case"), "c")
    sha = hashlib.sha256
    add = lambda name, *rows: case.append(name, Frames(spark, **{name: rows}).table(name))
    add("evidence_roots", {"id": 1, "path": str(home), "harness": "claude-code", "label": "R"}, {"id": 2, "path": str(tmp_path / "gone"), "harness": "cursor", "label": "G"})
    file = lambda i, rel, kind, h, v=1: {"id": i, "root_id": 1, "rel_path": rel, "version": v, "kind": kind, "sha256": h, "size": 2, "encoded": False}
    add("source_files", file(1, "d/a.jsonl", "file", sha(b"old").hexdigest()), file(2, "d/a.jsonl", "file", sha(b"x\n").hexdigest(), 2), file(3, "l", "symlink", sha(b"d/a.jsonl").hexdigest()), file(4, "m", "file", "no"))
    add("sessions", {"id": 1, "root_id": 1, "harness_session_id": "s", "kind": "primary", "first_ts": "2026-01-01T00:00:00.000Z"}, {"id": 2, "root_id": 1, "kind": "primary"})
    add("provenance", {"id": 5, "source_file_id": 2, "byte_offset": 3, "content_sha256": "c"}, {"id": 6, "source_file_id": 2, "byte_offset": 0, "locator": "row 1", "content_sha256": "c2"})
    add("messages", {"id": 1, "session_id": 1, "provenance_id": 5, "ordinal": 0, "role": "user", "record_type": "user", "timestamp": "2026-01-02T00:00:00.000Z", "timestamp_origin": "stored"}, {"id": 2, "session_id": 1, "provenance_id": 6, "ordinal": 1, "role": "assistant", "record_type": "assistant", "timestamp_origin": "absent"}, {"id": 3, "session_id": 1, "provenance_id": 77, "ordinal": 2, "role": "user", "record_type": "user"})
    add("blocks", {"id": 1, "message_id": 1, "ordinal": 1, "kind": "text", "text": "two"}, {"id": 2, "message_id": 1, "ordinal": 0, "kind": "text", "text": "one"}, {"id": 3, "message_id": 2, "ordinal": 0, "kind": "tool_use", "tool_call_id": 1})
    add("tool_calls", {"id": 1, "session_id": 1, "name": "Bash", "category": "shell", "input": '{"command":"ls"}', "is_error": True, "tool_use_block_id": 3})
    add("observations", {"id": 1, "session_id": 1, "kind": "command_executed", "command": "ls", "confidence": "high", "derived_from_tool_call_id": 1})
    return case


def test_timeline_of_a_case_and_its_exports(spark, tmp_path):
    import pyarrow.parquet as pq

    from sessionloom.operators import timeline
    from sessionloom.sinks import export

    case = _small_case(spark, tmp_path)
    got = timeline.of_case(case).orderBy(*sink.order()).collect()
    assert [(r["rank"], r.id) for r in got] == [(0, 2), (1, 1), (2, 1), (0, 1)]
    assert got[3].message == "[claude-code] user: one\ntwo" and got[3].display_name == "R:d/a.jsonl" and got[3].tags == ["claude-code", "user", "stored"] and got[3].attributes["evidence_byte_offset"] == "3"
    assert got[0].message == "[claude-code] assistant: <assistant>" and got[0].tags[-1] == "inferred" and got[0].datetime == "2026-01-01T00:00:00.000Z" and got[0].attributes["evidence_locator"] == "row 1" and "evidence_byte_offset" not in got[0].attributes
    assert got[1].message == "[claude-code] tool Bash: ls" and got[1].attributes["tool_error"] == "true" and got[2].source_long == "claude_code:observation:command_executed"
    for bad in ({"root_id": 9}, {"session_id": 9}):
        with pytest.raises(KeyError):
            export.run(case, "csv", **bad)
    with pytest.raises(ValueError):
        export.run(case, "csv", session_id=2)  # nothing to export
    with pytest.raises(ValueError):
        export.run(case, "csv", str(tmp_path / "home/out.csv"))
    done = [export.run(case, f, session_id=1) for f in export.FORMATS]
    lines = [json.loads(x) for x in open(done[0]["path"], encoding="utf-8")]
    assert len(lines) == 4 and lines[3]["message"].endswith("one\ntwo") and lines[1]["tool_name"] == "Bash"
    assert len(pq.read_table(done[2]["path"])) == 4 and all(d["sha256"] == hashlib.sha256(open(d["path"], "rb").read()).hexdigest() for d in done)
    assert [(r.format, r.rows, r.there) for r in export.listed(case).collect()] == [("parquet", 4, True), ("csv", 4, True), ("jsonl", 4, True)]
    name = done[1]["path"].rsplit("/", 1)[1]
    assert "-session-1" in name and export.file_of(case, name) == f"{case.path}/exports/{name}" and export.default_output(case, "csv", root_id=1).split("-")[-2:] == ["root", "1.csv"]
    with pytest.raises(KeyError):
        export.file_of(case, "../case.json")
    assert '"claude-code"' in export.report(case)


def test_verify(spark, tmp_path):
    from sessionloom.plans import verify

    case = _small_case(spark, tmp_path)
    case.put_blobs(spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),)], "content binary"))
    case.append("blobs", spark.createDataFrame([("0" * 64, 1)], "sha256 string, size long"))
    assert verify.verify(case) == {"files": {"ok": 2, "missing": 1}, "blobs": {"ok": 2, "bad": 1}, "roots_unavailable": [str(tmp_path / "gone")]}
    (tmp_path / "home/d/a.jsonl").write_text("changed")
    assert verify.verify(case)["files"] == {"ok": 1, "missing": 1, "drift": 1}
    found = case.table("anomalies").orderBy("id").collect()
    assert [r.id for r in found] == [1, 2, 3, 4, 5] and sorted((r.severity, r.source_file_id) for r in found[2:] if r.source_file_id) == [("error", 2), ("warning", 4)]
    assert case.table("audit_log").where("action = 'verify'").count() == 2


def test_diffs(spark):
    from sessionloom.functions import diff

    assert diff.is_binary(b"a\0") and diff.is_binary(b"\xff") and not diff.is_binary("aé".encode()[:-1]) and not diff.is_binary(b"")
    rows = [(1, bytearray(b"a\nb\n"), bytearray(b"a\nc\n")), (2, bytearray(b"\0"), bytearray(b"x")), (3, None, bytearray(b"new")), (4, bytearray(b"x" * (diff.MOST + 1)), bytearray(b"x"))]
    got = {r.id: r["diff"] for r in diff.diffs(spark.createDataFrame(rows, "id long, before binary, after binary")).collect()}
    assert json.loads(got[1].hunks)[0]["lines"] == [" a", "-b", "+c"] and got[2].binary and got[2].hunks is None and json.loads(got[3].hunks)[0]["lines"] == ["+new"] and got[4].too_large
