import contextlib
import hashlib
import json
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionloom.functions import diff, wire
from sessionloom.operators import trees
from sessionloom.sinks.case import Case
from sessionloom.sinks import timeline as sink
from sessionloom.sources import jsonl, manifest, sqlite, transcripts


def jsonl_records(spark, folder, files, split=None, cap=jsonl.CAP):
    for name, data in files.items():
        (folder / name).write_bytes(data)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before if split else ():
        spark.conf.set(k, str(split))
    try:
        return jsonl.records(jsonl.lines(spark, str(folder)), cap).orderBy("path", "index").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def plain_records(data):
    """(index, nth, offset, content, terminated) of each record, worked out byte by byte."""
    out, at = [], 0
    parts = data.split(b"\n")
    for i, line in enumerate(parts if parts[-1] else parts[:-1]):
        body = line[:-1] if line.endswith(b"\r") else line
        if body:
            out.append((i, len(out), at, body, at + len(line) < len(data)))
        at += len(line) + 1
    return out


def test_jsonl_places_bytes_exactly_in_splits(spark, tmp_path):
    n = iter(range(1000))

    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.lists(st.one_of(st.sampled_from([b"", b"\r", b"\xef\xbb\xbf", b"\xff\r", b"a+b"]), st.binary(max_size=40).map(lambda b: b.replace(b"\n", b""))), max_size=12), min_size=1, max_size=3), st.booleans(), st.sampled_from([5, 17, 64, 1 << 20]))
    def check(files, end, split):
        folder = tmp_path / str(next(n)) / "a b+c%20é"
        folder.mkdir(parents=True)
        data = {f"f{i}.jsonl": b"\n".join(lines) + (b"\n" if end and lines else b"") for i, lines in enumerate(files)}
        got = jsonl_records(spark, folder, data, split)
        want = [(name, *r) for name in sorted(data) for r in plain_records(data[name])]
        assert [(r.path, r["index"], r.nth, r.offset, bytes(r.content), r.terminated) for r in got] == want
        for r in got:
            assert data[r.path][r.offset : r.offset + r.length] == bytes(r.content) and r.sha256 == hashlib.sha256(r.content).hexdigest()

    check()


def test_jsonl_reads_one_file_in_many_tasks(spark, tmp_path):
    data = b"".join(b'{"n":%d}%s\n' % (i, b" " * (i % 50)) for i in range(20_000)) + b"{}"
    got = jsonl_records(spark, tmp_path, {"one.jsonl": data}, split=50_000)
    assert [(r["index"], r.nth, r.offset, bytes(r.content), r.terminated) for r in got] == plain_records(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    assert jsonl.lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_jsonl_drops_carriage_returns_and_flags_long_records(spark, tmp_path):
    got = jsonl_records(spark, tmp_path, {"f.jsonl": b"ab\r\n\r\n" + b"x" * 9 + b"\nz"}, cap=8)
    assert [(r["index"], r.offset, r.length, r.oversized, r.terminated) for r in got] == [(0, 0, 2, False, True), (2, 6, 9, True, True), (3, 16, 1, False, False)]


def test_jsonl_of_nothing(spark, tmp_path):
    assert jsonl_records(spark, tmp_path, {"none.txt": b"x", "empty.jsonl": b""}) == []


def test_manifest(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_bytes(b"abc")
    (tmp_path / "l").symlink_to("a/x.txt")
    got = {r.rel_path: r for r in manifest.manifest(spark, str(tmp_path)).collect()}
    assert got["a/x.txt"].sha256 == hashlib.sha256(b"abc").hexdigest() and got["l"].kind == "symlink" and got["l"].sha256 is None
    wanted = spark.createDataFrame([("a/x.txt", "no"), ("l", "no"), ("m", "no"), ("a/x.txt", got["a/x.txt"].sha256)], "rel_path string, sha256 string")
    assert sorted(r.state for r in manifest.sidecar(wanted, manifest.manifest(spark, str(tmp_path)), 10).collect()) == ["changed", "missing", "ok", "symlink"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "s 1.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE kv (key TEXT, value BLOB)")
    con.executemany("INSERT INTO kv VALUES (?, ?)", [("a:1", b"x"), ("a:2", "y" * 20), ("b:1", "z"), ("a;", "n")])
    con.execute("CREATE VIEW v AS SELECT * FROM kv")
    con.commit()
    con.close()
    got = sqlite.scan(spark, [path], "kv", prefix="a:", maxbytes="10").orderBy("key").collect()
    assert [(r.key, r["size"], r.value and bytes(r.value)) for r in got] == [("a:1", 1, b"x"), ("a:2", 20, None)]
    assert sqlite.scan(spark, [path], "kv").where(F.col("key").startswith("b")).count() == 1
    assert sqlite.scan(spark, [path], "v").count() == 0 and sqlite.scan(spark, [path], "none").count() == 0


def test_sqlite_in_ranges(spark, tmp_path):
    """One database is read by many tasks, each row once, in order; filters hold in every range; gaps and negative numbers of rows do no harm."""
    path = str(tmp_path / "big.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE kv (key TEXT UNIQUE, value BLOB)")
    con.executemany("INSERT INTO kv (rowid, key, value) VALUES (?, ?, ?)", [(i * i - 50, f"{'ab'[i % 2]}:{i}", b"v" * (i % 700)) for i in range(2000)])
    con.execute("CREATE TABLE none (key TEXT, value BLOB)")
    con.commit()
    con.close()
    one = [tuple(r) for r in sqlite.scan(spark, [path], "kv").collect()]
    df = sqlite.scan(spark, [path], "kv", rangebytes="40000")
    assert df.rdd.getNumPartitions() > 10 and [tuple(r) for r in df.collect()] == one and len(one) == 2000
    assert sum(n > 0 for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 5
    assert sqlite.scan(spark, [path], "kv", rangebytes="40000", prefix="a:").count() == 1000
    assert [r.row for r in sqlite.scan(spark, [path], "kv", rangebytes="40000").where("key = 'b:11'").collect()] == [71]
    assert sqlite.scan(spark, [path], "none", rangebytes="40000").count() == 0


def test_transcripts(spark, tmp_path):
    line = lambda **x: json.dumps(x)
    at = "2026-01-02T03:04:05.678901+01:00"
    content = "\n".join([
        line(type="user", sessionId="s", timestamp=at, message={"role": "user", "content": "hello token = abcdefghij"}),
        line(type="assistant", sessionId="s", timestamp=at, message={"model": "m1", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}, {"type": "tool_use", "id": "t2", "name": "MultiEdit", "input": {"file_path": "f", "edits": [{}, {}]}}]}),
        line(type="user", sessionId="s", message={"content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "out"}], "is_error": True}, {"type": "tool_result", "tool_use_id": "t9", "content": "lost"}]}),
        line(type="summary", summary="A", sessionId="s"), line(type="custom-title", customTitle="B", sessionId="s"), line(type="strange", sessionId="s"), "{bad", '{"type":"user"',
    ])
    (tmp_path / "p").mkdir()
    (tmp_path / "p/s.jsonl").write_text(content)
    r = transcripts.read(spark, str(tmp_path)).cache()
    b = transcripts.blocks(r).cache()
    m = {x["index"]: x for x in transcripts.messages(r, b).collect()}
    assert [m[i].role for i in sorted(m)] == ["user", "assistant", "tool", "meta", "meta", "meta"] and m[0].timestamp == "2026-01-02T02:04:05.678Z"
    calls = transcripts.tool_calls(b)
    assert sorted((c.name, c.status, c.category, c.is_error, c.result_text) for c in calls.collect()) == [("Bash", "paired", "shell", True, "out"), ("MultiEdit", "unfinished", "file_edit", False, None)]
    assert sorted((o["kind"] for o in transcripts.observations(calls).collect())) == ["command_executed", "file_edited", "file_edited"]
    assert sorted((a["kind"], a["index"]) for a in transcripts.anomalies(r, b).collect()) == [("malformed_record", 6), ("missing_timestamp", 2), ("truncated_line", 7), ("unknown_record_type", 5), ("unpaired_tool_result", 2)]
    assert [s.rule for s in transcripts.secret_candidates(b).collect()] == ["generic-assignment"]
    assert [t.title for t in transcripts.titles(r).collect()] == ["B"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_diff_restores_both_sides_with_least_edits(a, b):
    rows = diff.edits(a, b)
    assert [a[i] for t, i, _ in rows if t != "+"] == a and [b[j] for t, _, j in rows if t != "-"] == b
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    assert sum(t != " " for t, *_ in rows) == len(a) + len(b) - 2 * best[-1][-1]


def test_diff_hunks():
    old, new = "\n".join(map(str, range(1, 31))), "\n".join("x" if i in (5, 25) else str(i) for i in range(1, 31))
    h = diff.hunks(old, new)
    assert [(x["old_start"], x["new_start"]) for x in h] == [(2, 2), (22, 22)] and h[0]["lines"][3:5] == ["-5", "+x"]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_wire_never_fails(data):
    assert sum(len(s) for s in wire.strings(data)) <= max(60, 2 * len(data))
    wire.references(data)
    wire.is_tree_node(data)


def test_wire_nests():
    inner = wire.encode([(1, 0xFFFFFFFF), (2, "text".encode())])
    assert wire.strings(wire.encode([(1, inner), (2, b"\x00" * 32)])) == ["text"]
    assert wire.references(wire.encode([(1, inner), (2, b"\x01" * 32)])) == ["01" * 32] and wire.is_tree_node(wire.encode([(1, 5), (2, b"\x01" * 32)]))


def test_blob_order(spark):
    df = spark.createDataFrame([("s", "r", 3, True, ["b", "a"]), ("s", "a", 1, False, ["r"]), ("s", "b", 2, False, []), ("s", "z", 0, False, [])], "store string, id string, row long, root boolean, children array<string>")
    assert [(r.id, r.reached) for r in trees.blob_order(df).orderBy("position").collect()] == [("r", True), ("b", True), ("a", True), ("z", False)]


def test_case_and_sinks(spark, tmp_path):
    case = Case.create(spark, str(tmp_path / "case"), "c")
    with pytest.raises(ValueError):
        case.output("x", [str(tmp_path)], str(tmp_path / "a.csv"))
    case.put_blobs(spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "content binary"))
    case.put_blobs(spark.createDataFrame([(bytearray(b"a"),)], "content binary"))
    assert case.table("blobs").count() == 2
    events = spark.createDataFrame(
        [(0, 1, None, "No Timestamp", "m", "AI:X", "x", "d", [], {"b": "2", "message": "no"}, "f", "h", 5, "c", None, 7, None), (2, 2, "2026-01-01T00:00:00.000Z", "Seen (stored)", "o", "AI:X", "x", "d", ["t", "u"], {"a": "1"}, "f", "h", 6, "c", "row 1", 7, None)],
        "rank int, id long, datetime string, timestamp_desc string, message string, source string, source_long string, display_name string, tags array<string>, attributes map<string,string>, source_file string, file_hash string, byte_offset long, content_hash string, locator string, file_size long, file_mtime string",
    )
    sink.write_json_lines(events, str(tmp_path / "j"))
    lines = [json.loads(x) for x in (tmp_path / "j").read_text().splitlines()]
    assert [x["datetime"] for x in lines] == ["2026-01-01T00:00:00.000Z", None] and lines[0]["tag"] == ["t", "u"] and lines[1]["b"] == "2" and lines[1]["message"] == "m"
    sink.write_csv(events, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == [*sink.FIXED, "a", "b"]
    import pyarrow.parquet as pq

    assert sink.write_parquet(events, str(tmp_path / "p.parquet")) == 2
    t = pq.read_table(tmp_path / "p.parquet")
    assert t.schema.names == sink.PARQUET and t["byte_offset"].to_pylist() == [6, 5] and b"timeline.original_files" in t.schema.metadata
    assert len(case.exported(str(tmp_path / "p.parquet"), "parquet", 2)) == 64 and case.exports().count() == 1


def test_timelines_in_parts_are_those_in_one(spark, tmp_path):
    """Many parts, written side by side, give the bytes and rows of one part; ties of time and events without one are in order."""
    import pyarrow.parquet as pq

    n = 500
    stamp = F.when(F.col("id") % 7 > 0, F.concat(F.lit("2026-01-01T00:00:0"), (F.col("id") * 7919 % 10).cast("string"), F.lit(".000Z")))
    events = spark.range(n).select(
        (F.col("id") % 3).cast("int").alias("rank"), "id", stamp.alias("datetime"), F.lit("d").alias("timestamp_desc"), F.concat(F.lit('é "x", \n\\ '), F.col("id").cast("string")).alias("message"), F.lit("s").alias("source"), F.lit("l").alias("source_long"),
        F.when(F.col("id") % 2 == 0, "").otherwise("n").alias("display_name"), F.array(F.lit("t")).alias("tags"), F.create_map(F.lit("k,ey"), F.col("id").cast("string")).alias("attributes"), F.concat(F.lit("p/f"), (F.col("id") % 4).cast("string")).alias("source_file"),
        F.lit("h").alias("file_hash"), F.col("id").alias("byte_offset"), F.lit("c").alias("content_hash"), F.lit(None).cast("string").alias("locator"), F.col("id").alias("file_size"), F.lit("m").alias("file_mtime"),
    )
    for name, write in (("j", sink.write_json_lines), ("c", sink.write_csv)):
        one, many = write(events, str(tmp_path / f"{name}1")), write(events, str(tmp_path / f"{name}n"), part=60)
        assert len(one) == 1 and len(many) > 5 and sum(m["rows"] for m in many) == n and (tmp_path / f"{name}1").read_bytes() == (tmp_path / f"{name}n").read_bytes()
        with pytest.raises(FileExistsError):
            write(events, str(tmp_path / f"{name}1"))
    got = [json.loads(x) for x in (tmp_path / "jn").read_text().splitlines()]
    want = sorted(events.collect(), key=lambda r: (r.datetime is None, r.datetime or "", r["rank"], r.id))
    assert [(x["datetime"], x["message"], x["k,ey"]) for x in got] == [(r.datetime, r.message, str(r.id)) for r in want]
    assert [r["k,ey"] for r in spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(str(tmp_path / "cn")).collect()] == [str(r.id) for r in want]
    assert sink.write_parquet(events, str(tmp_path / "p1")) == sink.write_parquet(events, str(tmp_path / "pn"), part=60) == n
    names = sorted(x.name for x in (tmp_path / "pn").iterdir())
    assert names[0] == "_metadata" and len(names) > 6
    parts = [pq.read_table(tmp_path / "pn" / x) for x in names[1:]]
    one = pq.read_table(tmp_path / "p1")
    assert [i for t in parts for i in t["byte_offset"].to_pylist()] == one["byte_offset"].to_pylist() == [r.id for r in want]
    whole, facts = pq.read_metadata(tmp_path / "pn/_metadata"), json.loads(one.schema.metadata[b"timeline.original_files"])
    assert whole.num_rows == n and whole.row_group(0).column(0).file_path == names[1] and parts[0].schema.metadata == one.schema.metadata
    assert [(f["path"], f["name"]) for f in facts] == [(f"p/f{k}", f"f{k}") for k in range(4)] and facts[0]["size_bytes"] == next(r.file_size for r in want if r.source_file == "p/f0")


def brute_nested(rows):
    """(id, parent) in order of the list: depth first, cycles from their first row."""
    kids, ids, out = {}, {i for i, _ in rows}, {}
    for i, p in rows:
        if p in ids:
            kids.setdefault(p, []).append(i)

    def visit(i, path):
        waiting = [(i, path)]
        while waiting:
            i, path = waiting.pop()
            if i not in out:
                out[i] = [*path, i]
                waiting += [(k, out[i]) for k in reversed(kids.get(i, ()))]

    for i, p in [*((i, p) for i, p in rows if p is None or p not in ids), *rows]:
        visit(i, [])
    return {i: (len(x) - 1, "/".join(f"{k:019d}" for k in x)) for i, x in out.items()}


def test_nested_to_any_depth(spark):
    chain = [(i, i - 1 if i else None) for i in range(200)]
    cycle = [(1000, 1001), (1001, 1000), (1002, 1001), (1003, 1002), (1004, 1004), (1005, 9999), (1006, 1005), (1100, 1102), (1101, 1103), (1102, 1101), (1103, 1102), (1104, 1100), (1200, 1300), (1250, 1200), (1300, 1250)]
    got = {r.id: (r.depth, r.path) for r in trees.nested(spark, spark.createDataFrame(chain + cycle, "id long, parent_id long")).collect()}
    assert got == brute_nested(chain + cycle)
    assert [got[i][0] for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, 199)] == [0, 1, 2, 3, 0, 0, 1, 199]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 25), min_size=1, max_size=22))
def test_nested_and_ancestors_on_any_links(spark, parents):
    rows = list(enumerate(parents))
    df = spark.createDataFrame(rows, "id long, parent_id long")
    assert {r.id: (r.depth, r.path) for r in trees.nested(spark, df).collect()} == brute_nested(rows)
    want = set()
    for i, p in rows:
        seen, n = {i}, 0
        while p < len(rows) and p not in seen and n < 5:
            seen.add(p)
            n += 1
            want.add((i, p, n))
            p = parents[p]
    assert {tuple(r) for r in trees.ancestors(spark, df, 5).collect()} == want


def test_nested_many_sessions(spark):
    n = 2_000_000
    df = spark.range(n).select("id", F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") - 1).alias("parent_id"))
    assert {tuple(r) for r in trees.nested(spark, df).groupBy("depth").count().collect()} == {(k, n // 4) for k in range(4)}
    assert trees.ancestors(spark, df).count() == n // 4 * 6


def test_ranges_of_a_database_read_their_own_rows(tmp_path, monkeypatch):
    """No range comes to rows of another one, by the plan that SQLite makes; more ranges than RANGES are put together."""
    import sqlite3

    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE kv (key TEXT UNIQUE, value BLOB)")
        con.executemany("INSERT INTO kv VALUES (?, ?)", [(f"c:{i}" if i % 3 else f"d:{i}", b"v" * 50) for i in range(4000)])
    con.close()
    plans, opened = [], sqlite.opened

    class Seen:
        def __init__(self, con):
            self.con = con

        def execute(self, sql, values=()):
            plans.extend(bytes(r[3]).decode() if isinstance(r[3], bytes) else r[3] for r in self.con.execute("EXPLAIN QUERY PLAN " + sql, values))
            return self.con.execute(sql, values)

    @contextlib.contextmanager
    def watched(*a):
        with opened(*a) as (con, applied):
            yield Seen(con), applied

    monkeypatch.setattr(sqlite, "opened", watched)
    reader = sqlite.SqliteReader({"path": path, "table": "kv", "prefix": "c:", "rangebytes": "8192"})
    ranges = reader.partitions()
    rows = [r for x in ranges for r in reader.read(x)]
    assert len(ranges) > 10 and [r[1] for r in rows] == [i + 1 for i in range(4000) if i % 3]
    assert not [p for p in plans if p.startswith(("SCAN kv", "SEARCH kv")) and "INTEGER PRIMARY KEY" in p and "rowid>" not in p and "rowid<" not in p] and not [p for p in plans if "autoindex_kv" in p and "key>" in p]
    assert not [p for p in plans if p == "SCAN kv"]
    monkeypatch.setattr(sqlite, "RANGES", 4)
    fewer = reader.partitions()
    assert len(fewer) <= 5 and [r for x in fewer for r in reader.read(x)] == rows


def test_tasks_grow_no_further_than_a_bound():
    assert [manifest.tasks(n, 64) for n in (0, 64, 65, 10**7)] == [1, 1, 2, manifest.TASKS]


def test_transcripts_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """One file in each folder, with lines in order of turns, and no file of Spark's writer beside it."""
    import os

    from sessionloom.plans import bindings

    monkeypatch.setattr(bindings, "_scratch", lambda spark, name: str(tmp_path / name))
    rows = [(c, t, "user", f"a{t}" if t else None) for c in range(30) for t in (2, 0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    at = bindings._transcripts(spark, str(tmp_path), "t")
    assert sorted(os.listdir(at)) == sorted(f"conv_id={c}" for c in range(30)) and {tuple(os.listdir(f"{at}/conv_id={c}")) for c in range(30)} == {("part-0.txt",)}
    with open(f"{at}/conv_id=7/part-0.txt", "rb") as f:
        assert f.read().split(b"\n")[1:] == [b'{"turn":1,"role":"user","words":"a\xc3\xa9"}', b'{"turn":2,"role":"user","words":"a\xc3\xa9"}', b""]
