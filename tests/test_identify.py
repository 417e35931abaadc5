import json
import os
import sqlite3

import pytest
from sessionloom.plans import attach
from sessionloom.sinks.case import Case
from sessionloom.sources import identify, manifest


def database(path, *statements):
    path.parent.mkdir(parents=True, exist_ok=True)
    with sqlite3.connect(path) as con:
        for s in statements:
            con.execute(s)
    con.close()


def test_directories_are_known_by_their_contents(spark, tmp_path):
    kv = "CREATE TABLE cursorDiskKV (key TEXT, value BLOB)"
    items = "CREATE TABLE ItemTable (key TEXT, value BLOB)"
    chats = ["CREATE TABLE blobs (id TEXT, data BLOB)", "CREATE TABLE meta (key TEXT, value TEXT)"]
    root = lambda n: tmp_path / n
    for name in ("claude", "deep", "history", "agents", "txt", "links", "fake"):
        root(name).mkdir()
    (root("claude") / "projects/p").mkdir(parents=True)
    (root("claude") / "projects/p/a.jsonl.orphaned-1").write_text('{"parentUuid":null,"sessionId":"s"}\n')
    (root("deep") / "projects/a/b/c/d").mkdir(parents=True)
    (root("deep") / "projects/a/b/c/d/x.jsonl").write_text('{"parentUuid":null,"sessionId":"s"}\n')
    (root("history") / "history.jsonl").write_text('{"display":"x","sessionId":"s"}\n')
    (root("agents") / "projects/p/agent-transcripts").mkdir(parents=True)
    (root("agents") / "projects/p/agent-transcripts/s.jsonl").write_text("{}\n")
    (root("txt") / "projects/p/agent-transcripts").mkdir(parents=True)
    (root("txt") / "projects/p/agent-transcripts/s.txt").write_text("x")
    database(root("store") / "chats/w/a/store.db", *chats)
    database(root("global") / "User/globalStorage/state.vscdb", kv)
    database(root("legacy") / "User/globalStorage/state.vscdb", items)
    database(root("space") / "User/workspaceStorage/w/state.vscdb", items, "INSERT INTO ItemTable VALUES ('composer.composerData', '{}')")
    database(root("other") / "User/workspaceStorage/w/state.vscdb", items)
    (root("fake") / "chats/w/a").mkdir(parents=True)
    (root("fake") / "chats/w/a/store.db").write_bytes(b"SQLite format 3\0 but no more")
    os.symlink(root("claude") / "projects", root("links") / "projects")
    found = {n: identify.identify(spark, str(root(n))) for n in os.listdir(tmp_path)}
    assert {n: list(x) for n, x in found.items()} == {
        "claude": ["claude-code"], "history": ["claude-code"], "agents": ["cursor"], "txt": ["cursor"], "store": ["cursor"], "global": ["cursor-ide"], "space": ["cursor-ide"], "deep": [], "links": [], "legacy": [], "other": [], "fake": [],
    }
    assert found["claude"]["claude-code"] == ["projects transcript carrying parentUuid and sessionId: projects/p/a.jsonl.orphaned-1"] and found["store"]["cursor"] == ["chat store with tables blobs and meta: chats/w/a/store.db"]
    inside = {r.inside: {r.harness: r.signs} for r in identify.candidates(spark, str(tmp_path)).collect()}
    assert inside == {n: found[n] for n in found if found[n]} and list(inside) == sorted(inside)
    made = {n: {k: g for k, g in identify.generations(spark, str(root(n)), manifest.listing(spark, str(root(n)))).items() if k != "cursor:chat-store"} for n in ("agents", "txt", "global", "legacy", "claude")}
    assert made == {"agents": {"cursor:agent-transcripts": "jsonl"}, "txt": {"cursor:agent-transcripts": "txt"}, "global": {"cursor:state-vscdb": "cursor-disk-kv"}, "legacy": {"cursor:state-vscdb": "itemtable-legacy"}, "claude": {}}
    assert json.loads(attach.inventory(spark, str(tmp_path)))["inside"][str(root("space"))] == found["space"]


def test_a_directory_is_attached_by_its_signs(spark, tmp_path):
    home = tmp_path / "in/home/projects/p"
    home.mkdir(parents=True)
    for name, versions in {"a": ["2.1.9", "9.0.0"], "b": ["2.1.10"], "c": []}.items():
        (home / f"{name}.jsonl").write_text('{"parentUuid":null,"sessionId":"s"}\n{broken\n' + "".join(json.dumps({"type": "user", "version": v, "message": {"content": "hi"}}) + "\n" for v in versions))
    case = Case.create(spark, str(tmp_path / "case"), "c")
    with pytest.raises(ValueError, match=r"it contains .*home \(claude-code\)"):
        attach.attach(case, str(tmp_path / "in"), "x")
    assert attach.attach(case, str(tmp_path / "in/home"), "x") == 1
    r = case.table("evidence_roots").first()
    assert r.harness == "claude-code" and json.loads(r.identification) == ["projects transcript carrying parentUuid and sessionId: projects/p/a.jsonl"]
    assert [(s.kind, s.generation) for s in case.table("stores").collect()] == [("claude:projects", "2.1.10")]
    (tmp_path / "in/home/chats").mkdir()
    (tmp_path / "in/home/prompt_history.json").write_text("[]")
    with pytest.raises(ValueError, match="claude-code, cursor; name one"):
        attach.attach(case, str(tmp_path / "in/home"), "x")
