"""Takes a directory of agent transcripts into a case: files, records, sessions, messages, blocks, calls, observations, claims, anomalies.

Ids are dense and follow the order of files and of places in them, since ties are broken by the least id. They
are given by one sort in each file and a frame of one count for each file, so no step sorts a whole table in one task.
A second call takes up only what is new or changed: a changed file becomes a new version beside the old one.
"""

from __future__ import annotations

import datetime
import json
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import secrets, spans, text, times
from ..operators import linking, reports, sessions as s, tools
from ..session import ordered_numbers
from ..sources import identify, jsonl, manifest, transcripts

# Stores of a root in the order in which they are read.
STORES = {
    "claude:projects": "projects",
    "claude:history": "history.jsonl",
    "claude:file-history": "file-history",
    "claude:shell-snapshots": "shell-snapshots",
    "claude:todos": "todos",
    "claude:plans": "plans",
    "claude:paste-cache": "paste-cache",
    "claude:uploads": "uploads",
    "claude:settings": "settings.json",
}
# Stores that a parser reads; the others are only listed.
READ = {"claude:projects", "cursor:agent-transcripts", "cursor:chat-store", "claude:history", "claude:uploads", "cursor:state-vscdb", "cursor:workspace-storage", "cursor:local-history"}
# Severities of anomalies; all others are warnings.
SEVERITIES = {"malformed_record": "error", "unknown_record_type": "info", "invalid_utf8": "info", "orphaned_file": "info", "superseded_file": "info", "symlink_in_evidence": "info", "non_utf8_path": "info"}
# Parsers by name and version.
PARSERS = {"transcript": ("claude_code.transcript", "1"), "meta": ("claude_code.subagent_meta", "1"), "history": ("claude_code.history", "1"), "upload": ("claude_code.uploads", "1")}
#: Longer sidecar files are not read.
MOST_BYTES = 64 << 20
UNBOUNDED = ["transcript", "history", "kv", "workspace", "chat"]


def numbered(rows: DataFrame, within: list, start: int) -> DataFrame:
    """rows with id, from start + 1, in order of file_id and then of `within`."""
    before = Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("file_id").agg(F.count("*").alias("n")).select("file_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    w = Window.partitionBy("file_id").orderBy(*within)
    return rows.join(base, "file_id").withColumn("id", F.lit(start) + F.col("base") + F.row_number().over(w)).drop("base")


def numbered_by(rows: DataFrame, nth: str, start: int) -> DataFrame:
    """rows with id, from start + 1, in order of file_id and then of their number in the file (nth, 0 upwards without gaps); no window over the rows of a file."""
    before = Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("file_id").agg(F.count("*").alias("n")).select("file_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "file_id").withColumn("id", F.lit(start + 1) + F.col("base") + F.col(nth)).drop("base", nth)


def last_id(case, table: str) -> int:
    return case.table(table).agg(F.max("id")).first()[0] or 0


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parser_of(path: Column, kind: Column) -> Column:
    """Which parser reads a file; null for files that are only listed."""
    name, parts = name_of(path), F.split(path, "/")
    transcript = name.rlike(r"\.jsonl$|\.jsonl\.(orphaned|superseded)-")
    meta = name.endswith(".meta.json") & (F.try_element_at(parts, F.lit(-2)) == "subagents")
    return F.when(kind == "symlink", None).when(path.startswith("projects/") & transcript, "transcript").when(path.startswith("projects/") & meta, "meta").when(path == "history.jsonl", "history").when(path.startswith("uploads/") & (F.size(parts) == 3), "upload")


def ingest(case, path: str, label: str) -> int:
    """Takes up what is new below path, a directory of transcripts, under a label; gives the root's id."""
    return take_up(case, path, label, "claude-code", STORES, parser_of, Load)


def take_up(case, path: str, label: str, harness: str, expected: dict[str, str], parser, loader) -> int:
    """Lists the stores and files of a root and lets loader(case, root_id, path, files).run(changed) read those that are new or changed."""
    path = os.path.abspath(path)
    root = case.table("evidence_roots").where(F.col("path") == path).select("id").first()
    root_id = root[0] if root else last_id(case, "evidence_roots") + 1
    listed = case.stage(manifest.listing(case.spark, path))
    found = case.stage(manifest.stores(manifest.hashed(listed, path, links=False), expected))
    if not root:
        at = datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        signs = identify.identify(case.spark, path, listed).get(harness) or ["named by the caller; no signs matched"]
        row = [(root_id, label, path, harness, json.dumps(signs), True, at)]
        case.append("evidence_roots", case.spark.createDataFrame(row, "id long, label string, path string, harness string, identification string, retained boolean, added_at string"))
    _stores(case, root_id, path, expected, listed)
    _unreadable(case, root_id, found)
    files, drift = _files(case, root_id, found, expected, parser)
    if files.isEmpty():
        return root_id
    loader(case, root_id, path, files).run(drift)
    case.audit("ingest", {"root": root_id, "files": files.count(), "parsed": files.where("parser is not null").count(), "report": reports.ingest(case, root_id).first().asDict()})
    return root_id


def _stores(case, root_id: int, path: str, expected: dict[str, str], listed: DataFrame) -> None:
    """Stores of the root that are there, and those that are absent."""
    known = {r.kind for r in case.table("stores").where(F.col("root_id") == root_id).select("kind").collect()}
    names = {r.rel_path for r in listed.where(F.col("rel_path").isin(*expected.values())).select("rel_path").distinct().collect()}  # of expected stores at most
    there = [(k, p) for k, p in expected.items() if p in names]
    start = last_id(case, "stores")
    new = [(k, p) for k, p in there if k not in known]
    if new:
        made = identify.generations(case.spark, path, listed)
        rows = [(start + i + 1, root_id, k, p, made.get(k), "parsed" if k in READ else "inventoried") for i, (k, p) in enumerate(new)]
        case.append("stores", case.spark.createDataFrame(rows, "id long, root_id long, kind string, rel_path string, generation string, status string"))
    gone = [(root_id, k) for k in expected if k not in dict(there)]
    rest = case.table("absent_stores").where(F.col("root_id") != root_id)
    case.replace("absent_stores", rest.unionByName(case.spark.createDataFrame(gone, "root_id long, kind string")))


def _unreadable(case, root_id: int, found: DataFrame) -> None:
    """An anomaly for each name of the root that could not be read, once for each error."""
    rel, error = F.col("rel_path"), F.col("error")
    rows = found.where("kind = 'unreadable'").select(F.concat(rel, F.lit(" could not be read during attach: "), error).alias("message"), F.to_json(F.struct(rel, error)).alias("details")).distinct()
    told = case.table("anomalies").where((F.col("root_id") == root_id) & (F.col("kind") == "unreadable_file")).select("message")
    new = ordered_numbers(rows.join(told, "message", "left_anti"), "message")
    case.append("anomalies", new.select((F.col("number") + last_id(case, "anomalies") + 1).alias("id"), F.lit(root_id).alias("root_id"), F.lit("unreadable_file").alias("kind"), F.lit("error").alias("severity"), "message", "details"))


def _files(case, root_id: int, found: DataFrame, expected: dict[str, str], parser) -> tuple[DataFrame, DataFrame]:
    """Adds new and changed files to the manifest; gives them with their parser, and those that changed."""
    old = case.table("source_files").where(F.col("root_id") == root_id)
    newest = old.groupBy("rel_path", "encoded").agg(F.max("version").alias("was"), F.max_by(F.struct("sha256", "parse_status", "id"), "version").alias("x"))
    both = found.where("store is not null and kind <> 'unreadable'").join(newest, ["rel_path", "encoded"], "left")
    failed = F.col("x.parse_status").isin("unparsed", "failed")
    changed = F.col("was").isNotNull() & ~F.col("x.sha256").eqNullSafe(F.col("sha256"))
    stores = case.table("stores").where(F.col("root_id") == root_id).select(F.col("kind").alias("store"), F.col("id").alias("store_id"))
    order = F.array_position(F.array(*(F.lit(k) for k in expected)), F.col("store"))
    new = both.where(F.col("was").isNull() | changed | failed).join(stores, "store").withColumn("version", F.coalesce("was", F.lit(0)) + 1).withColumn("drift", changed).withColumn("file_id", order)
    new = numbered(new, ["rel_path"], last_id(case, "source_files"))
    by = parser(F.col("rel_path"), F.col("kind"))
    files = case.stage(new.withColumn("parser", F.when(~F.col("encoded") & ((F.col("size") <= MOST_BYTES) | by.isin(*UNBOUNDED)), by)).withColumn("root_id", F.lit(root_id).cast("long")).drop("file_id", "error").withColumn("file_id", F.col("id")))
    return files, files.where("drift")


class Load:
    """The plans of one ingest. Each table is written once and read again by what builds on it."""

    def __init__(self, case, root_id: int, path: str, files: DataFrame):
        self.case, self.root_id, self.path, self.files = case, root_id, path, files
        self.parsed = files.where("parser is not null")

    def run(self, drift: DataFrame) -> None:
        self.records = self._records()
        self.transcript = self.case.stage(transcripts.fields(self.records.where("parser = 'transcript'"), "pid", "file_id").withColumn("session", F.col("path")))
        self.found = self.case.stage(transcripts.blocks(self.transcript))
        self.history = self._history()
        self.sessions = self._sessions()
        self.lookup = self.sessions.select("harness_session_id", "id").union(self._known().select("harness_session_id", "id")).groupBy("harness_session_id").agg(F.min("id").alias("session_id"))
        self.by_file = self.sessions.where("kind in ('primary', 'subagent')").select(F.col("rel_path").alias("path"), F.col("id").alias("session_id"))
        self.meta = self._meta()
        self.messages = self._messages()
        self.blocks = self._blocks()
        self.calls = self._calls()
        self.pastes = self._pastes()
        self._write(drift)
        self._generation()
        finish(self.case, self.root_id)

    def _generation(self) -> None:
        """The newest version that the first versioned record near the top of a transcript names, kept with the store of projects."""
        stores = self.case.table("stores")
        ours = (F.col("root_id") == self.root_id) & (F.col("kind") == "claude:projects")
        named = self.records.where((F.col("parser") == "transcript") & (F.col("offset") + F.col("length") <= identify.HEAD)).select("file_id", "index", text.json_text(F.col("text"), "version").alias("version")).where("version is not null")
        first = named.groupBy("file_id").agg(F.min_by("version", "index").alias("version")).select("version")
        known = stores.where(ours & F.col("generation").isNotNull()).select(F.col("generation").alias("version"))
        newest = s.generation(first.unionAll(known).withColumn("root_id", F.lit(self.root_id).cast("long"))).withColumnRenamed("generation", "newest")
        self.case.replace("stores", stores.join(newest, "root_id", "left").withColumn("generation", F.when(ours, F.col("newest")).otherwise(F.col("generation"))).select(*stores.columns))

    def _known(self) -> DataFrame:
        return self.case.table("sessions").where(F.col("root_id") == self.root_id)

    def _records(self) -> DataFrame:
        """Every record that is parsed, with its number (pid), which is also that of its provenance."""
        wanted = self.parsed.select(F.col("rel_path").alias("path"), "file_id", "parser", F.col("sha256").alias("file_sha"), F.col("size").alias("length"))
        listed = wanted.where("parser in ('transcript', 'history')").select("path")
        split = jsonl.parsed(jsonl.records(jsonl.lines(self.case.spark, self.path).join(listed, "path", "left_semi")))
        body = contents(self.case, self.path, "*.meta.json").withColumnRenamed("rel_path", "path").join(wanted.where("parser = 'meta'").select("path"), "path", "left_semi")
        one = lambda length: [F.lit(0).cast("long").alias("index"), F.lit(0).cast("long").alias("nth"), F.lit(0).cast("long").alias("offset"), length, F.lit(True).alias("terminated"), F.lit(False).alias("oversized")]
        whole = jsonl.parsed(body.select("path", *one(F.col("length")), "content", F.sha2("content", 256).alias("sha256")))
        uploads = wanted.where("parser = 'upload'").select("path", *one(F.col("length")), F.col("file_sha").alias("sha256"))
        every = split.unionByName(whole).drop("content").unionByName(uploads, allowMissingColumns=True)
        rows = every.join(wanted.select("path", "file_id", "parser"), "path")
        return self.case.stage(numbered_by(rows, "nth", last_id(self.case, "provenance")).withColumnRenamed("id", "pid"))

    def _history(self) -> DataFrame:
        """Lines of the prompt history with their session's name, time and pastes."""
        r = self.records.where("parser = 'history' and (anomaly is null or anomaly = 'invalid_utf8')")
        get = lambda p: F.get_json_object("text", p)
        at = times.lenient(get("$.timestamp"))
        pasted = F.from_json(get("$.pastedContents"), "map<string,string>")
        return self.case.stage(r.select("pid", "file_id", "path", "index", "offset", "text", text.json_text(F.col("text"), "sessionId").alias("hsid"), text.json_text(F.col("text"), "project").alias("project"), text.json_text(F.col("text"), "display").alias("display"), at.alias("timestamp"), F.map_entries(pasted).alias("pasted")))

    def _sessions(self) -> DataFrame:
        """New sessions: one for each transcript; one for each name that only the history or uploads know."""
        parts, name = F.split("rel_path", "/"), name_of(F.col("rel_path"))
        sub = F.try_element_at(parts, F.lit(-2)) == "subagents"
        own = self.parsed.where("parser = 'transcript'").select("file_id", "store_id", "rel_path", F.lit(0).cast("long").alias("place"), F.regexp_extract(name, r"^(.*?)\.jsonl", 1).alias("harness_session_id"), F.when(sub, "subagent").otherwise("primary").alias("kind"), F.when(sub, F.try_element_at(parts, F.lit(-3))).alias("parent_harness_session_id"), F.lit(None).cast("string").alias("project"))
        h = self.history.where("hsid <> ''").select("file_id", F.col("index").alias("place"), F.col("hsid").alias("harness_session_id"), "project")
        u = self.parsed.where("parser = 'upload'").select("file_id", F.lit(0).cast("long").alias("place"), F.split("rel_path", "/")[1].alias("harness_session_id"), F.lit(None).cast("string").alias("project"))
        known = own.select("harness_session_id").union(self._known().select("harness_session_id"))
        lone = h.unionByName(u).join(known, "harness_session_id", "left_anti")
        lone = lone.groupBy("harness_session_id").agg(F.min(F.struct("file_id", "place", "project")).alias("x")).select("harness_session_id", "x.*")
        lone = lone.join(self.files.select("file_id", "store_id", "rel_path"), "file_id").withColumn("kind", F.lit("sidecar_only"))
        rows = own.unionByName(lone, allowMissingColumns=True)
        return self.case.stage(numbered(rows, ["place", "harness_session_id"], last_id(self.case, "sessions")).withColumn("root_id", F.lit(self.root_id).cast("long")))

    def _meta(self) -> DataFrame:
        """Subagents' descriptions with the session that each describes, if there is one."""
        r = self.records.where("parser = 'meta' and (anomaly is null or anomaly = 'invalid_utf8')")
        named = r.withColumn("harness_session_id", F.regexp_replace(name_of(F.col("path")), r"\.meta\.json$", ""))
        return self.case.stage(named.join(self.lookup, "harness_session_id", "left").withColumn("title", text.json_text(F.col("text"), "description")).withColumn("spawner", text.json_text(F.col("text"), "toolUseId")))

    def _messages(self) -> DataFrame:
        t = transcripts.messages(self.transcript, self.found).drop("session", "ordinal", "sha256", "offset", "length")
        raw = self.transcript.select("path", "index", "pid", "file_id", "text")
        conversation = F.col("record_type").isin(*transcripts.CONVERSATION)
        t = t.join(raw, ["path", "index"]).join(self.by_file, "path").withColumn("attributes", F.when(conversation, spans.attributes_udf("text")).otherwise(F.col("text"))).drop("text")
        m = self.meta.where("session_id is not null").select("path", "index", "pid", "file_id", "session_id", F.lit("meta").alias("role"), F.lit("subagent-meta").alias("record_type"), F.lit("absent").alias("timestamp_origin"), F.concat(F.lit('{"subagent_meta":'), "text", F.lit("}")).alias("attributes"))
        only = self.sessions.where("kind = 'sidecar_only'").select(F.col("harness_session_id").alias("hsid"), F.col("id").alias("session_id"))
        only = only.union(self._known().where("kind = 'sidecar_only'").select("harness_session_id", "id"))
        h = self.history.join(only, "hsid").select("path", "index", "pid", "file_id", "session_id", F.lit("user").alias("role"), F.lit("history").alias("record_type"), "timestamp", F.when(F.col("timestamp").isNull(), "absent").otherwise("stored").alias("timestamp_origin"), F.col("text").alias("attributes"))
        rows = numbered(t.unionByName(m, allowMissingColumns=True).unionByName(h, allowMissingColumns=True), ["index"], last_id(self.case, "messages"))
        before = self.case.table("messages").groupBy("session_id").agg((F.max("ordinal") + 1).alias("next"))
        place = F.row_number().over(Window.partitionBy("session_id").orderBy("id")) - 1
        return self.case.stage(rows.join(before, "session_id", "left").withColumn("ordinal", (place + F.coalesce("next", F.lit(0))).cast("long")).drop("next"))

    def _blocks(self) -> DataFrame:
        m = self.messages.select("path", "index", F.col("id").alias("message_id"), "file_id", "session_id", F.col("timestamp_origin"))
        shown = self.history.where("display is not null").select("path", "index", F.lit(0).cast("long").alias("ordinal"), F.lit("text").alias("kind"), F.col("display").alias("text"), F.to_json(F.col("display").cast("variant")).alias("payload"), "timestamp")
        rows = self.found.unionByName(shown, allowMissingColumns=True).join(m, ["path", "index"])
        return self.case.stage(numbered(rows, ["index", "ordinal"], last_id(self.case, "blocks")))

    def _calls(self) -> DataFrame:
        """Calls in the order in which they are given out."""
        c = transcripts.tool_calls(self.found)
        b = self.found.where("kind in ('tool_use', 'tool_result') and tool_use_id is not null")
        stream = b.select(F.struct("path", "tool_use_id").alias("key"), F.struct("index", "ordinal").alias("position"), F.when(F.col("kind") == "tool_use", "use").otherwise("result").alias("kind"))
        order = tools.emission_order(tools.pair(stream).withColumn("file", F.col("key.path")), stream).select(F.col("key.path").alias("path"), F.col("key.tool_use_id").alias("tool_use_id"), "use_position", "number")
        own = self.blocks.select("path", F.struct("index", "ordinal").alias("use_position"), F.col("id").alias("use_block"), "file_id", "session_id", "timestamp_origin")
        result = self.blocks.select("path", F.struct("index", "ordinal").alias("result_position"), F.col("id").alias("result_block"))
        rows = c.join(order, ["path", "tool_use_id", "use_position"]).join(own, ["path", "use_position"]).join(result, ["path", "result_position"], "left")
        return self.case.stage(numbered(rows, ["number"], last_id(self.case, "tool_calls")))

    def _pastes(self) -> DataFrame:
        """Pastes of the prompt history: session, id, and the content, inline or from the paste cache."""
        p = self.history.where("hsid <> ''").select("pid", "file_id", "index", "hsid", "timestamp", F.posexplode("pasted").alias("n", "p"))
        get = lambda k: text.json_text(F.col("p.value"), k)
        p = p.select("pid", "file_id", "index", "hsid", "timestamp", "n", F.coalesce(F.get_json_object("p.value", "$.id"), F.col("p.key")).alias("paste_id"), get("content").alias("inline"), get("contentHash").alias("hash"))
        unsafe = F.coalesce(text.unsafe_component(F.col("hash")), F.lit(False))
        p = p.withColumn("unsafe", unsafe & F.col("inline").isNull()).withColumn("rel", F.when(F.col("inline").isNull() & ~unsafe, F.concat(F.lit("paste-cache/"), "hash", F.lit(".txt"))))
        cached = contents(self.case, self.path, "*.txt").where(F.col("length") <= MOST_BYTES).select(F.col("rel_path").alias("rel"), "content")
        listed = self.case.table("source_files").where(F.col("root_id") == self.root_id).select("rel_path").union(self.files.select("rel_path")).distinct()
        cached = cached.where(F.col("rel").startswith("paste-cache/")).join(listed.withColumnRenamed("rel_path", "rel"), "rel", "left_semi")
        return self.case.stage(p.join(cached, "rel", "left").join(self.lookup.withColumnRenamed("harness_session_id", "hsid"), "hsid", "left"))

    def _deltas(self) -> DataFrame:
        """Edits that the harness announced by a backup."""
        d = self.transcript.where("record_type = 'file-history-delta'")
        get = lambda p: F.try_variant_get(F.try_parse_json("text"), p, "string")
        parent, tracked, name = get("$.backup.realParentDir"), get("$.trackingPath"), get("$.backup.backupFileName")
        full = F.when(parent.isNull(), tracked).otherwise(text.join_evidence(parent, tracked))
        at = F.coalesce(times.normalise(get("$.timestamp")), times.normalise(get("$.backup.backupTime")))
        details = _json(source=F.lit("file-history-delta"), trackingPath=tracked, backupFileName=name, version=F.try_variant_get(F.try_parse_json("text"), "$.backup.version", "variant"), backupTime=get("$.backup.backupTime"), messageId=get("$.messageId"))
        hsid = F.regexp_extract(name_of(F.col("path")), r"^(.*?)\.jsonl", 1)
        rows = d.select("pid", "path", "file_id", "index", full.alias("target"), name.alias("backup"), at.alias("timestamp"), details.alias("details"), F.when(~text.unsafe_component(name), F.concat(F.lit("file-history/"), hsid, F.lit("/"), name)).alias("rel_path"))
        backups = self.case.table("source_files").where((F.col("root_id") == self.root_id) & (F.col("kind") == "file") & (F.col("size") <= MOST_BYTES)).select("rel_path", "version", F.col("sha256").alias("before_blob"))
        backups = backups.groupBy("rel_path").agg(F.max_by("before_blob", "version").alias("before_blob"))
        return rows.join(backups, "rel_path", "left").join(self.by_file, "path")

    def _observations(self, edits: DataFrame) -> DataFrame:
        calls = edits.select("session_id", "file_id", "kind", F.col("id").alias("derived_from_tool_call_id"), F.col("target").alias("path"), "command", F.sha2("before", 256).alias("before_blob"), F.sha2("after", 256).alias("after_blob"), "timestamp", "timestamp_origin", "confidence", "details", F.struct(F.lit(0).alias("a"), F.col("number").cast("long").alias("b"), F.col("edit").cast("long").alias("c")).alias("place"))
        place = lambda kind, b, c=F.lit(0): F.struct(F.lit(kind).alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c")).alias("place")
        stamped = F.when(F.col("timestamp").isNull(), "absent").otherwise("stored").alias("timestamp_origin")
        deltas = self._deltas().select("session_id", "file_id", F.lit("file_edited").alias("kind"), F.col("pid").alias("derived_from_provenance_id"), F.col("target").alias("path"), "before_blob", "timestamp", stamped, F.lit("medium").alias("confidence"), "details", place(1, F.col("index")))
        state = F.when(F.col("inline").isNotNull(), F.struct(F.col("paste_id").alias("id"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("content_blob"), F.octet_length("inline").cast("long").alias("size"), F.lit(True).alias("inline"), F.lit(False).alias("missing")))
        state = state.otherwise(F.struct(F.col("paste_id").alias("id"), F.col("hash").alias("content_hash"), F.when(F.col("content").isNotNull(), F.sha2("content", 256)).alias("content_blob"), F.octet_length("content").cast("long").alias("size"), F.lit(False).alias("inline"), F.col("content").isNull().alias("missing")))
        one = self.pastes.groupBy("pid").agg(F.first("file_id").alias("file_id"), F.first("index").alias("index"), F.first("session_id").alias("session_id"), F.first("timestamp").alias("timestamp"), F.array_sort(F.collect_list(F.struct("n", state.alias("x")))).alias("xs"))
        shown = self.history.select("pid", "display", "project", F.get_json_object("text", "$.pastedContents").alias("contents"))
        pasted = one.join(shown, "pid").select("session_id", "file_id", F.lit("paste_detected").alias("kind"), F.col("pid").alias("derived_from_provenance_id"), "timestamp", stamped, F.lit("high").alias("confidence"), _json(display=F.col("display"), pastedContents=F.try_parse_json("contents"), project=F.col("project"), pastes=F.transform("xs", lambda x: x["x"])).alias("details"), place(2, F.col("index")))
        u = self.records.where("parser = 'upload'").select("pid", "path", "file_id", F.split("path", "/")[1].alias("harness_session_id"), F.split("path", "/")[2].alias("name"), "sha256", "length")
        u = u.join(self.lookup, "harness_session_id").join(self.files.select("file_id", "mtime"), "file_id").join(self._heads(), "path", "left")
        uploads = u.select("session_id", "file_id", F.lit("upload_detected").alias("kind"), F.col("pid").alias("derived_from_provenance_id"), F.col("name").alias("path"), F.col("mtime").alias("timestamp"), F.when(F.col("mtime").isNull(), "absent").otherwise("file_mtime").alias("timestamp_origin"), F.lit("high").alias("confidence"), _json(content_blob=F.col("sha256"), size=F.col("length"), mime=text.mime(F.col("head"), F.col("name")), sessionId=F.col("harness_session_id")).alias("details"), place(3, F.lit(0)))
        hit = lambda field, **extra: _json(rule=F.col("m.rule"), rule_version=F.lit("1"), field=field, offset=F.col("m.offset"), length=F.col("m.length"), match=F.col("m.match"), **extra)
        common = ["session_id", "file_id", F.lit("secret_candidate").alias("kind"), "timestamp", F.col("m.confidence").alias("confidence")]
        in_blocks = secrets.scan(self.blocks, F.col("text"), "session_id", "file_id", "timestamp", "id", "timestamp_origin", "kind").select(*common, F.col("id").alias("derived_from_block_id"), "timestamp_origin", hit(F.col("kind")).alias("details"), place(4, F.col("id"), F.col("m.offset")))
        in_calls = secrets.scan(self.calls, F.col("input"), "session_id", "file_id", "timestamp", "id", "timestamp_origin").select(*common, F.col("id").alias("derived_from_tool_call_id"), "timestamp_origin", hit(F.lit("tool_input")).alias("details"), place(5, F.col("id"), F.col("m.offset")))
        body = F.coalesce("inline", F.make_valid_utf8(F.col("content").cast("string")))
        in_pastes = secrets.scan(self.pastes, body, "session_id", "file_id", "timestamp", "pid", "index", "paste_id").select(*common, F.col("pid").alias("derived_from_provenance_id"), stamped, hit(F.lit("paste"), paste_id=F.col("paste_id")).alias("details"), place(6, F.col("index"), F.col("m.offset")))
        out = calls
        for more in (deltas, pasted, uploads, in_blocks, in_calls, in_pastes):
            out = out.unionByName(more, allowMissingColumns=True)
        return numbered(out.where("session_id is not null"), ["place", "kind", "details"], last_id(self.case, "observations"))

    def _heads(self) -> DataFrame:
        f = contents(self.case, self.path).select(F.col("rel_path").alias("path"), F.substring("content", 1, 16).alias("head"))
        return f.where(F.col("path").startswith("uploads/"))

    def _claims(self) -> DataFrame:
        own = F.regexp_extract(name_of(F.col("path")), r"^(.*?)\.jsonl", 1)
        t = self.transcript.join(self.by_file, "path").select("session_id", "file_id", own.alias("own"), text.json_text(F.col("text"), "sessionId").alias("a"), text.json_text(F.col("text"), "session_id").alias("b"))
        a = t.where("a is not null").select("session_id", "file_id", F.lit("claude:sessionId").alias("scheme"), F.col("a").alias("claimed_id"), F.when(F.col("a") == F.col("own"), "matched").otherwise("unmatched").alias("join_status"))
        b = t.where("b is not null and b <> own").select("session_id", "file_id", F.lit("claude:origin_session_id").alias("scheme"), F.col("b").alias("claimed_id"), F.lit("unmatched").alias("join_status"))
        m = self.meta.where("session_id is not null and spawner is not null").select("session_id", "file_id", F.lit("claude:spawning_tool_use_id").alias("scheme"), F.col("spawner").alias("claimed_id"), F.lit("unmatched").alias("join_status"))
        order = F.when(F.col("scheme") == "claude:sessionId", 0).when(F.col("scheme") == "claude:origin_session_id", 1).otherwise(2)
        return numbered(a.union(b).union(m).distinct(), [order, "claimed_id"], last_id(self.case, "identity_claims"))

    def _anomalies(self, drift: DataFrame) -> DataFrame:
        """What is odd, in files, records and references."""
        own = self.by_file
        t = transcripts.anomalies(self.transcript, self.found).join(own, "path").join(self.transcript.select("path", "index", "pid", "file_id"), ["path", "index"])
        t = t.select("file_id", "session_id", "pid", F.col("index").alias("place"), "kind", F.lit("{}").alias("details"))
        name = name_of(F.col("rel_path"))
        flagged = self.parsed.where("parser = 'transcript'").select("file_id", F.col("rel_path").alias("path"), F.explode(F.filter(F.array(F.when(F.contains(name, F.lit(".orphaned-")), "orphaned_file"), F.when(F.contains(name, F.lit(".superseded-")), "superseded_file")), lambda x: x.isNotNull())).alias("kind"), _json(file_name=name).alias("details")).join(own, "path").drop("path")
        other = self.records.where("parser in ('history', 'meta') and anomaly is not null").select("file_id", "pid", F.col("index").alias("place"), F.col("anomaly").alias("kind"), F.when((F.col("parser") == "meta") & (F.col("anomaly") == "malformed_record"), "warning").alias("given"), F.lit("{}").alias("details"))
        nameless = self.history.where("coalesce(hsid, '') = ''").select("file_id", "pid", F.col("index").alias("place"), F.lit("malformed_record").alias("kind"), F.lit("info").alias("given"), _json(record=F.try_parse_json("text")).alias("details"))
        first = self.history.select("hsid", "file_id", "index", "pid").withColumnRenamed("index", "place")
        lone = self.sessions.where("kind = 'sidecar_only'").select(F.col("harness_session_id").alias("hsid"), F.col("id").alias("session_id"), "file_id", "place")
        gone = lone.join(first, ["hsid", "file_id", "place"], "left").select("file_id", "session_id", "pid", "place", F.lit("missing_transcript").alias("kind"), _json(sessionId=F.col("hsid")).alias("details"))
        bare = self.meta.where("session_id is null").select("file_id", "pid", F.lit("missing_transcript").alias("kind"), _json(sessionId=F.col("harness_session_id"), subagent_meta=F.try_parse_json("text")).alias("details"))
        paths = self.pastes.where("unsafe").select("file_id", "session_id", "pid", F.col("index").alias("place"), F.lit("suspicious_path").alias("kind"), _json(contentHash=F.col("hash")).alias("details"))
        names = self._deltas().where(text.unsafe_component(F.col("backup"))).select("file_id", "session_id", "pid", F.col("index").alias("place"), F.lit("suspicious_path").alias("kind"), _json(backupFileName=F.col("backup")).alias("details"))
        links = self.files.where("kind = 'symlink'").select("file_id", F.lit("symlink_in_evidence").alias("kind"), F.lit("{}").alias("details"))
        odd = self.files.where("encoded").select("file_id", F.lit("non_utf8_path").alias("kind"), _json(rel_path=F.col("rel_path")).alias("details"))
        moved = drift.select("file_id", F.lit("hash_drift").alias("kind"), _json(version=F.col("version")).alias("details"))
        out = t
        for more in (flagged, other, nameless, gone, bare, paths, names, links, odd, moved):
            out = out.unionByName(more, allowMissingColumns=True)
        severity = F.lit("warning")
        for k, v in SEVERITIES.items():
            severity = F.when(F.col("kind") == k, v).otherwise(severity)
        rows = numbered(out, ["place", "kind", "details"], last_id(self.case, "anomalies"))
        return rows.join(self.files.select("file_id", "rel_path"), "file_id").select("id", F.lit(self.root_id).alias("root_id"), F.col("file_id").alias("source_file_id"), "session_id", F.col("pid").alias("provenance_id"), "kind", F.coalesce("given", severity).alias("severity"), F.concat(F.replace("kind", F.lit("_"), F.lit(" ")), F.lit(" in "), "rel_path").alias("message"), "details")

    def _write(self, drift: DataFrame) -> None:
        case, edits = self.case, self.case.stage(effects(self.calls))
        write_files(case, self.files, self.records.groupBy("file_id").agg(F.count("*").alias("record_count")))
        parser = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in PARSERS.items() for x in (k, v[i]))), F.col("parser"))
        lone = self.messages.where("record_type = 'history'").select("pid", F.lit("derived").alias("o")).distinct()
        case.append("provenance", self.records.where("not oversized").join(lone, "pid", "left").select(F.col("pid").alias("id"), F.col("file_id").alias("source_file_id"), F.col("offset").alias("byte_offset"), F.col("length").alias("byte_length"), F.col("sha256").alias("content_sha256"), parser(0).alias("parser"), parser(1).alias("parser_version"), F.coalesce("o", F.lit("stored")).alias("origin")))
        case.append("messages", self.messages.withColumnRenamed("pid", "provenance_id"))
        calls = self.calls.select("id", F.explode(F.filter(F.array("use_block", "result_block"), lambda x: x.isNotNull())).alias("block")).groupBy("block").agg(F.max("id").alias("tool_call_id"))
        case.append("blocks", self.blocks.join(calls.withColumnRenamed("block", "id"), "id", "left"))
        case.append("tool_calls", self.calls.withColumnsRenamed({"use_block": "tool_use_block_id", "result_block": "tool_result_block_id", "outcome": "result_payload"}))
        case.append("observations", self._observations(edits))
        case.append("identity_claims", self._claims())
        case.append("anomalies", self._anomalies(drift))
        drafts = self.transcript.join(self.by_file, "path").select("session_id", F.struct(F.lit(0).alias("late"), F.col("index")).alias("position"), transcripts.title_of().alias("title"), "cwd")
        late = self.meta.where("session_id is not null").select("session_id", F.struct(F.lit(1).alias("late"), F.col("index")).alias("position"), "title", F.lit(None).cast("string").alias("cwd"))
        new = self.sessions.join(s.merge_fields(drafts.unionByName(late)).withColumnRenamed("session_id", "id"), "id", "left")
        case.append("sessions", new.withColumn("project_path", F.coalesce("project", "cwd")).withColumn("bounds_from_adapter", F.lit(False)))
        late = self.meta.join(self._known().select(F.col("id").alias("session_id")), "session_id", "left_semi").where("title is not null").groupBy("session_id").agg(F.max_by("title", "pid").alias("late"))
        case.replace("sessions", case.table("sessions").join(late.withColumnRenamed("session_id", "id"), "id", "left").withColumn("title", F.coalesce("late", "title")))
        texts = edits.select(F.explode(F.array("before", "after")).alias("t")).where("t is not null").select(F.encode("t", "UTF-8").alias("content"))
        case.put_blobs(texts.union(self.pastes.where("content is not null").select("content")))
        case.put_files(self.files.where("kind = 'file' and (parser = 'upload' or startswith(rel_path, 'file-history/') or startswith(rel_path, 'uploads/'))"), self.path)


def write_files(case, files: DataFrame, counts: DataFrame) -> None:
    """Adds files with their numbers of records (file_id, record_count); older versions of them are superseded."""
    read = F.col("parser").isNotNull()
    new = files.join(counts, "file_id", "left").withColumn("parse_status", F.when(read, "parsed").otherwise("inventoried")).withColumn("record_count", F.when(read, F.coalesce("record_count", F.lit(0))))
    again = files.select("root_id", "rel_path").withColumn("again", F.lit(True))
    old = case.table("source_files").join(again, ["root_id", "rel_path"], "left").withColumn("parse_status", F.when(F.col("again"), "superseded").otherwise(F.col("parse_status")))
    columns = case.table("source_files").columns
    case.replace("source_files", old.select(*columns).unionByName(new.withColumn("error", F.lit(None)).withColumn("btime", F.lit(None).cast("string")).select(*columns)))


def contents(case, root: str, glob: str | None = None) -> DataFrame:
    """rel_path, length, content of the files below a root."""
    return jsonl.binary_files(case.spark, root, glob).select(jsonl.relative(F.col("path"), root).alias("rel_path"), "length", "content")


def _json(**members: Column) -> Column:
    """A JSON object with all members, also those without a value."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in members.items())), {"ignoreNullFields": "false"})


def effects(calls: DataFrame) -> DataFrame:
    """Observations of calls with what stood before and after, and their details; one for each edit."""
    arg = lambda k: text.json_text(F.col("input"), k)
    out = lambda k: text.json_text(F.col("outcome"), k)
    part = lambda c, k: F.try_variant_get(F.try_parse_json(c), f"$.{k}", "variant")
    o = transcripts.observations(calls).select("path", "tool_use_id", "use_position", "kind", "target", "command", "confidence", "edit")
    rows = o.join(calls.select("id", "path", "tool_use_id", "use_position", "name", "input", "outcome", "file_id", "session_id", "number", "timestamp", "timestamp_origin"), ["path", "tool_use_id", "use_position"])
    edit = F.try_element_at(F.from_json("input", "edits array<struct<old_string:string,new_string:string,replace_all:boolean>>")["edits"], F.col("edit"))
    n = F.col("name")
    before = F.when(n == "Write", out("originalFile")).when(n == "Edit", F.coalesce(out("oldString"), arg("old_string"))).when(n == "MultiEdit", edit["old_string"])
    after = F.when(n == "Write", F.coalesce(arg("content"), out("content"))).when(n == "Edit", F.coalesce(out("newString"), arg("new_string"))).when(n == "MultiEdit", edit["new_string"]).when(n == "NotebookEdit", arg("new_source"))
    target = F.coalesce("target", F.when(n.isin("Write", "Edit"), out("filePath")))
    details = (
        F.when(n == "Bash", _json(description=arg("description"), interrupted=part("outcome", "interrupted"), stderr_present=F.coalesce(F.length(out("stderr")) > 0, F.lit(False))))
        .when(n.isin("Glob", "Grep"), _json(pattern=arg("pattern"), tool=n)).when(n == "Write", _json(result_type=out("type"), userModified=part("outcome", "userModified")))
        .when(n == "Edit", _json(replaceAll=F.coalesce(part("outcome", "replaceAll"), F.parse_json(F.lit("false"))), structuredPatch=F.coalesce(part("outcome", "structuredPatch"), F.parse_json(F.lit("[]"))), userModified=part("outcome", "userModified")))
        .when(n == "MultiEdit", _json(edit_index=F.col("edit") - 1, replaceAll=F.coalesce(edit["replace_all"], F.lit(False)))).when(n == "NotebookEdit", _json(cell_id=arg("cell_id"), edit_mode=arg("edit_mode")))
        .when(n == "WebFetch", _json(prompt=arg("prompt"))).when(n == "WebSearch", _json(query=arg("query")))
        .when(n.isin("Agent", "Task"), _json(subagent_type=arg("subagent_type"), description=arg("description"), prompt_length=F.coalesce(F.octet_length(arg("prompt")), F.lit(0)), agent_id=out("agentId"), status=out("status"))).otherwise("{}")
    )
    return rows.withColumn("before", before).withColumn("after", after).withColumn("target", target).withColumn("details", details)


def finish(case, root_id: int) -> None:
    """Links, counts and bounds of all sessions of a root, from what is in the case."""
    every = case.table("sessions")
    mine = every.where(F.col("root_id") == root_id)
    m = case.table("messages").join(mine.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    by_name = linking.parents(mine.select("root_id", "id", F.col("harness_session_id").alias("name"), F.col("parent_session_id").alias("parent_id"), F.col("parent_harness_session_id").alias("parent_name")))
    claims = case.table("identity_claims")
    open_ = claims.join(mine.select(F.col("id").alias("session_id")), "session_id", "left_semi").where("join_status = 'unmatched' and not startswith(scheme, 'cursor:')").select("id", F.col("session_id").alias("session"), "scheme", F.col("claimed_id").alias("claimed"))
    spawned = open_.where("scheme = 'claude:spawning_tool_use_id'")
    users = case.table("blocks").where("kind = 'tool_use'").select("tool_use_id", "message_id").join(m.select(F.col("id").alias("message_id"), "session_id"), "message_id").select(F.col("tool_use_id").alias("claimed"), F.col("session_id").alias("candidate")).distinct()
    hits = spawned.join(users, "claimed").groupBy("id").agg(F.count("*").alias("hits"), F.min("candidate").alias("match"))
    by_use = spawned.join(hits, "id", "left").select("id", "session", F.lit("spawn").alias("by"), F.when(F.col("hits") == 1, "matched").when(F.col("hits") > 1, "ambiguous").otherwise("unmatched").alias("status"), F.when(F.col("hits") == 1, F.col("match")).alias("match"))
    rest = open_.where("scheme <> 'claude:spawning_tool_use_id'")
    by_id = linking.resolve(rest, mine.select(F.col("harness_session_id").alias("claimed"), F.col("id").alias("candidate"))).join(rest.select("id", "scheme"), "id")
    by_id = by_id.select("id", "session", F.when(F.col("scheme") == "claude:origin_session_id", "origin").otherwise("name").alias("by"), "status", "match")
    resolved = case.stage(by_use.unionByName(by_id))
    case.replace("identity_claims", claims.join(resolved.select("id", "status"), "id", "left").withColumn("join_status", F.coalesce("status", "join_status")))
    adopted = linking.adopt(resolved.where("by = 'spawn'")).select(F.col("session").alias("id"), F.col("parent_id").alias("adopted"))
    resumed = resolved.where("by = 'origin' and status = 'matched'").select(F.col("session").alias("id")).distinct().withColumn("resumed", F.lit(True))
    files = case.table("source_files").select(F.col("id").alias("source_file_id"), "mtime")
    first_file = m.select("session_id", "provenance_id", "id").join(case.table("provenance").select(F.col("id").alias("provenance_id"), "source_file_id"), "provenance_id").groupBy("session_id").agg(F.min_by("source_file_id", "id").alias("source_file_id")).join(files, "source_file_id").select("session_id", "mtime")
    limits = s.bounds(m.select("session_id", "timestamp", F.col("timestamp_origin").alias("ts_origin"), "ordinal"), first_file).withColumnsRenamed({"session_id": "id", "first_ts": "f", "first_ts_origin": "fo", "last_ts": "l", "last_ts_origin": "lo"})
    facts = m.groupBy("session_id").agg(F.count_if(F.col("role") != "meta").alias("mc"), F.array_sort(F.collect_set("model")).alias("ms")).withColumnRenamed("session_id", "id")
    called = case.table("tool_calls").groupBy("session_id").agg(F.count("*").alias("tc")).withColumnRenamed("session_id", "id")
    out = mine
    for more in (by_name.withColumnRenamed("parent_id", "named"), adopted, resumed, limits, facts, called):
        out = out.join(more, "id", "left")
    free = ~F.coalesce("bounds_from_adapter", F.lit(False))
    out = out.withColumns({
        "parent_session_id": F.coalesce("parent_session_id", "named", "adopted"), "kind": F.when((F.col("kind") == "primary") & F.col("resumed"), "resumed").otherwise(F.col("kind")), "models": F.array_sort(F.array_union(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("models", "ms")))), "message_count": F.coalesce("mc", F.lit(0)), "tool_call_count": F.coalesce("tc", F.lit(0)),
        "first_ts": F.when(free, F.col("f")).otherwise(F.col("first_ts")), "last_ts": F.when(free, F.col("l")).otherwise(F.col("last_ts")), "first_ts_origin": F.when(free, F.coalesce("fo", F.lit("absent"))).otherwise(F.col("first_ts_origin")), "last_ts_origin": F.when(free, F.coalesce("lo", F.lit("absent"))).otherwise(F.col("last_ts_origin")),
    }).select(*every.columns)
    case.replace("sessions", every.where(F.col("root_id") != root_id).unionByName(out))
    told = case.table("anomalies").where("kind = 'unlinked_subagent'").select(F.col("session_id").alias("id"))
    alone = linking.missing(case.table("sessions").where((F.col("root_id") == root_id) & (F.col("kind") == "subagent") & F.col("parent_session_id").isNull()), told, ["id"])
    start = last_id(case, "anomalies")
    rows = alone.select(F.col("store_id").alias("file_id"), F.col("id").alias("session_id"), F.concat(F.lit("subagent session "), "harness_session_id", F.lit(" has no parent transcript in this root")).alias("message"))
    case.append("anomalies", numbered(rows, ["session_id"], start).select("id", F.lit(root_id).alias("root_id"), "session_id", F.lit("unlinked_subagent").alias("kind"), F.lit("warning").alias("severity"), "message", F.lit("{}").alias("details")))
