"""A case: annotations, contents in blocks, raw bytes, odd names, verification and reports."""

import base64
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import annotations, api, reports
from sessionloom.plans import ingest, verify
from sessionloom.sinks import contents
from sessionloom.sinks.case import Case
from sessionloom.sources import manifest


@pytest.fixture
def case(spark, tmp_path):
    return Case.create(spark, str(tmp_path / "case"), "c")


def fill(case):
    one = lambda name, **x: case.append(name, case.spark.createDataFrame([tuple(x.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in x.items())))
    for name in ("sessions", "observations", "anomalies", "source_files"):
        one(name, id=1)
    for m in (1, 2):
        one("messages", id=m, session_id=1)
        one("blocks", id=10 * m, message_id=m)
    one("tool_calls", id=5, session_id=1, tool_use_block_id=10, tool_result_block_id=20)


def test_annotations_of_all_targets(case):
    fill(case)
    ids = {"session": 1, "message": 1, "block": 20, "tool_call": 5, "observation": 1, "anomaly": 1, "source_file": 1}
    made = [case.annotate(t, ids[t], annotations.KINDS[k % 3], f"{t} é") for k, t in enumerate(annotations.TARGETS)]
    assert made == list(range(1, 8)) and [(r.target_type, r.kind) for r in case.annotations().collect()] == [(t, annotations.KINDS[k % 3]) for k, t in enumerate(annotations.TARGETS)]
    assert [r.id for r in case.annotations("block").collect()] == [3] and [r.id for r in case.annotations("block", 20).collect()] == [3] and case.annotations("block", 10).count() == 0
    of = lambda m: [r.target_type for r in api.annotations_of_message(case, m).collect()]
    assert of(1) == ["message", "tool_call"] and of(2) == ["block", "tool_call"] and of(3) == []
    case.remove_annotation(4)
    assert of(2) == ["block"] and case.annotations().count() == 6
    with pytest.raises(KeyError):
        case.remove_annotation(4)
    told = [(r.action, json.loads(r.details)) for r in api.audit(case).collect()]
    assert [a for a, _ in told] == ["case_created"] + ["annotation_created"] * 7 + ["annotation_deleted"] and told[4][1]["value"] == told[8][1]["value"] == "tool_call é" and told[8][1]["at"].endswith("Z")
    assert case.annotate("tool_call", 5, "tag", "again") == 8


def test_invalid_annotations_are_refused_without_a_trace(case):
    fill(case)
    for bad in (("blob", 1, "tag", "x"), ("message", 1, "star", "x"), ("message", 1, "tag", " \n\t"), ("message", 1, "note", "é" * 32769), ("message", 9, "tag", "x"), ("tool_call", 1, "tag", "x"), ("block", None, "tag", "x"), (None, 1, "tag", "x"), ("message", 1, None, "x"), ("message", 1, "tag", None)):
        with pytest.raises(ValueError):
            case.annotate(*bad)
    assert case.table("annotations").count() == 0 and case.table("audit_log").count() == 1
    assert case.annotate("message", 1, "note", "é" * 32768) == 1


def test_contents_are_kept_in_blocks(spark, case, tmp_path):
    data = {"big": bytes(range(256)) * 40 + b"end", "even": b"x" * 300, "none": b"", "small": b"ab", "copy": b"ab", os.fsdecode(b"odd\xff"): b"o" * 250}
    root = tmp_path / "in"
    root.mkdir()
    for name, content in data.items():
        (root / name).write_bytes(content)
    files = manifest.listing(spark, str(root))
    gone = spark.createDataFrame([("gone", False)], "rel_path string, encoded boolean")
    for _ in range(2):
        case.put_files(files.select("rel_path", "encoded").union(gone), str(root), block=100)
    held = case.table("blob_contents")
    sha = {name: hashlib.sha256(content).hexdigest() for name, content in data.items()}
    assert {(r.sha256, r["size"]) for r in case.table("blobs").collect()} == {(sha[n], len(c)) for n, c in data.items()} and case.table("blobs").count() == 5
    assert held.where(F.length("content") > 100).count() == 0 and held.where(F.col("sha256") == sha["big"]).count() == 103
    for name, content in data.items():
        for offset, length in ((0, 10), (95, 10), (100, 100), (99, 5000), (len(content), 5), (10**6, 3), (0, 0)):
            assert bytes(contents.between(held, sha[name], offset, length).first()["bytes"]) == content[offset : offset + length]
    assert contents.between(held, "0" * 64, 0, 9).count() == 0
    states = lambda: {r.sha256: r.state for r in verify.blobs(case).collect()}
    assert set(states().values()) == {"ok"}
    case.append("blobs", spark.createDataFrame([("f" * 64, 3)], "sha256 string, size long"))
    case.append("blob_contents", spark.createDataFrame([("e" * 64, 0, bytearray(b"zz"))], "sha256 string, at long, content binary"))
    tampered = case.table("blob_contents").withColumn("content", F.when((F.col("sha256") == sha["big"]) & (F.col("at") == 500), F.lit(b"?")).otherwise(F.col("content"))).where(~((F.col("sha256") == sha["even"]) & (F.col("at") == 100)))
    case.replace("blob_contents", tampered)
    assert states() == {sha["big"]: "bad", sha["even"]: "bad", "f" * 64: "bad", "e" * 64: "unindexed"} | {sha[n]: "ok" for n in ("none", "small", os.fsdecode(b"odd\xff"))}


def test_previews_of_contents(spark, case):
    case.put_blobs(spark.createDataFrame([(bytearray(b"ab" * 50_000),), (bytearray(b"ab" * 50_000),)], "content binary"))
    assert case.table("blob_contents").count() == 4 and case.table("blobs").first()["size"] == 100_000 and [r.state for r in verify.blobs(case).collect()] == ["ok"]
    rows = [b"plain", "cut é".encode()[:-1], "cut \U0001f600".encode()[:-1], b"\xffno", b"nul\0", b"", "é".encode() + b"\xe9x", b"a" * 20]
    case.put_blobs(spark.createDataFrame([(bytearray(x),) for x in rows], "content binary"))
    from sessionloom.functions.diff import is_binary

    for x in rows:
        r = api.blob(case, hashlib.sha256(x).hexdigest(), cap=10).first()
        assert (r["size"], r.truncated, r.binary) == (len(x), len(x) > 10, is_binary(x[:10])), x
        assert base64.b64decode(r.bytes_b64) == x[:10] if r.binary else r.text == x[:10].decode(errors="ignore")
    assert api.blob(case, "0" * 64).count() == 0
    with pytest.raises(ValueError):
        api.blob(case, "../" + "0" * 61)


def home(tmp_path):
    at = tmp_path / "home/projects/p"
    at.mkdir(parents=True)
    line = lambda kind, content, **x: json.dumps({"type": kind, "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "version": "1", "message": {"content": content}} | x) + "\n"
    data = line("user", "password = hunter2hunter2 é") + line("assistant", [{"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "ls"}}]) + line("user", [{"type": "tool_result", "tool_use_id": "t", "content": "out"}]) + line("user", "<system-reminder>x", isMeta=True) + '{"type":"user"'
    (at / "a.jsonl").write_text(data)
    (tmp_path / "home/uploads/s").mkdir(parents=True)
    (tmp_path / "home/uploads/s/u.bin").write_bytes(b"\0\1\2")
    (at / os.fsdecode(b"odd\xff%.jsonl")).write_bytes(b"{}")
    return data.encode()


def test_raw_bytes_reports_and_verification_of_an_ingest(spark, case, tmp_path):
    data = home(tmp_path)
    ingest.ingest(case, str(tmp_path / "home"), "x")
    for p in case.table("provenance").where("parser = 'claude_code.transcript'").orderBy("id").collect():
        whole = data[p.byte_offset : p.byte_offset + p.byte_length]
        for offset, length in ((0, api.WINDOW), (3, 7), (len(whole) - 2, 50), (len(whole) + 9, 5)):
            r = api.raw(case, p.id, offset, length).first()
            assert (r.total_length, r.offset, base64.b64decode(r.bytes_b64), r.verified) == (len(whole), min(offset, len(whole)), whole[offset : offset + length], True)
    assert api.raw(case, 999).count() == 0
    upload = case.table("provenance").where("parser = 'claude_code.uploads'").first()
    (tmp_path / "home/uploads/s/u.bin").unlink()  # the kept copy is read
    assert base64.b64decode(api.raw(case, upload.id).first().bytes_b64) == b"\0\1\2"
    odd = case.table("source_files").where("encoded").first()
    assert odd.rel_path == "projects/p/odd%FF%25.jsonl" and odd.sha256 == hashlib.sha256(b"{}").hexdigest() and [r.kind for r in api.anomalies(case, kind="non_utf8_path").collect()] == ["non_utf8_path"]
    session = case.table("sessions").where("kind = 'primary'").first().id
    shown = {r.ordinal: r for r in api.messages(case, session).collect()}
    assert shown[2].absorbed and not shown[0].absorbed and shown[3].injected_label == "system reminder" and shown[0].injected_label is None
    assert [(r.tool_call_id, r.message_ids) for r in api.absorbed_results(case, session).collect()] == [(1, [shown[2].id])]
    told = lambda revealed: [json.loads(r.details)["match"] for r in api.activity_page(case, "indicators", revealed).collect() if r.kind == "secret_candidate"]
    assert told(True) == ["password = hunter2hunter2"] and told(False) == ["pass" + "•" * 21]
    report = reports.ingest(case).first()
    assert (report.files_parsed, report.messages, report.tool_calls, report.sessions) == (2, case.table("messages").count(), 1, 2) and report.parsers == "claude_code.transcript/1, claude_code.uploads/1"
    kinds = [r.kind for r in api.anomaly_kinds(case).collect()]
    assert kinds == sorted(set(kinds)) and "truncated_line" in kinds
    lines = [r.line for r in reports.inventory(case).orderBy("part", "root", "id").collect()]
    assert lines[0].startswith("root 1 claude-code x (") and any(x.startswith("  file ") and "odd%FF%25.jsonl" in x for x in lines) and lines[-1].startswith("audit log (") and sum(x.startswith("anomalies (") for x in lines) == 1
    assert "msgs=" in reports.sessions(api.sessions(case)).first().line and reports.evidence(case).first().line.startswith("1  claude-code  x  ")
    found = verify.verify(case)
    assert found["files"] == {"ok": 2, "missing": 1} and found["blobs"].keys() == {"ok"}
    (tmp_path / "home/projects/p/a.jsonl").write_bytes(data.replace(b"hunter2", b"hunter3"))
    with pytest.raises(ValueError):
        api.raw(case, case.table("provenance").where("byte_offset = 0 and parser = 'claude_code.transcript'").first().id)
    assert reports.verified(verify.verify(case)).splitlines()[:4] == ["verify done", "  files_checked: 3", "  drifted: 1", "  missing: 1"]


def test_what_cannot_be_read_is_a_row(spark, case, tmp_path):
    home(tmp_path)
    (tmp_path / "home/projects/p/link").symlink_to("/nowhere")
    root = str(tmp_path / "home")
    listed = case.stage(manifest.listing(spark, root))
    assert {r.rel_path: r["kind"] for r in listed.where("not encoded").collect()} == {"projects": "dir", "projects/p": "dir", "projects/p/a.jsonl": "file", "projects/p/link": "symlink", "uploads": "dir", "uploads/s": "dir", "uploads/s/u.bin": "file"}
    (tmp_path / "home/uploads/s/u.bin").unlink()
    got = {r.rel_path: (r["kind"], r.sha256, r.error) for r in manifest.hashed(listed, root).collect()}
    assert got["uploads/s/u.bin"] == ("unreadable", None, "No such file or directory") and got["projects/p/link"][1] == hashlib.sha256(b"/nowhere").hexdigest()
    assert [(r["kind"], r.error) for r in manifest.listing(spark, str(tmp_path / "none")).collect()] == [("unreadable", "No such file or directory")]
    assert manifest.listing(spark, root, 1).count() == 2
    ingest._unreadable(case, 1, manifest.hashed(listed, root))
    ingest._unreadable(case, 1, manifest.hashed(listed, root))
    assert [(r.kind, r.severity, r.message, json.loads(r.details)["rel_path"]) for r in case.table("anomalies").collect()] == [("unreadable_file", "error", "uploads/s/u.bin could not be read during attach: No such file or directory", "uploads/s/u.bin")]
