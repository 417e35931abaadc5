"""Takes the directory of an editor into a case: composers and bubbles of its key-value store, workspaces, local history.

A composer is a session; a bubble is a message, and a second one where it holds the result of a tool. Bubbles stand in the
order of their composer's list, those that it does not list after them. Every record is kept as a blob, and its provenance
names the row instead of a place in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans, text, times
from ..operators import linking
from ..sources import sqlite
from .ingest import MOST_BYTES, _json, contents, finish, last_id, numbered, take_up, write_files

# Stores of a root in the order in which they are read.
STORES = {"cursor:state-vscdb": "User/globalStorage", "cursor:workspace-storage": "User/workspaceStorage", "cursor:local-history": "User/History"}
# Parsers by name and version.
PARSERS = {"kv": ("cursor-kv", "1"), "local_history": ("cursor-history", "1")}
# Fields of a bubble that have a meaning here or are known to have none.
BUBBLE_FIELDS = "_v bubbleId type createdAt modelInfo text thinking toolFormerData images richText codeBlocks tokenCount isAgentic capabilityType context relevantFiles suggestedCodeBlocks attachedCodeChunks cursorRules lints serverBubbleId usageUuid".split()
# Severities of anomalies; all others are warnings.
SEVERITIES = {"malformed_record": "error", "unknown_record_type": "info", "unreferenced_record": "info", "unknown_field": "info", "wal_applied": "info", "symlink_in_evidence": "info", "non_utf8_path": "info"}


def parser_of(path: Column, kind: Column) -> Column:
    """Which parser reads a file; null for files that are only listed."""
    return F.when(kind == "symlink", None).when(path == "User/globalStorage/state.vscdb", "kv").when(path.rlike("^User/workspaceStorage/[^/]+/state\\.vscdb$"), "workspace").when(path.rlike("^User/History/[^/]+/entries\\.json$"), "local_history")


def ingest(case, path: str, label: str) -> int:
    """Takes up what is new below path, an editor's directory, under a label; gives the root's id."""
    return take_up(case, path, label, "cursor-ide", STORES, parser_of, EditorLoad)


def _place(group: Column, key: Column, n: Column, part: Column) -> Column:
    return F.struct(group.cast("long").alias("group"), key.cast("string").alias("key"), n.cast("long").alias("n"), part.cast("long").alias("part"))


class EditorLoad:
    """The plans of one ingest. Each table is written once and read again by what builds on it."""

    def __init__(self, case, root_id: int, path: str, files: DataFrame):
        self.case, self.root_id, self.path, self.files = case, root_id, path, files

    def run(self, drift: DataFrame) -> None:
        self.rows = self._rows()
        self.composers = self._composers()
        self.bubbles = self._bubbles()
        self.entries = self._entries()
        self.provenance = self._provenance()
        self.sessions = self._sessions()
        self.parts = self._parts()
        self.messages = self._messages()
        self.blocks = self._blocks()
        self.calls = self._calls()
        self._write(drift)
        finish(self.case, self.root_id)
        join_claims(self.case)

    def _scan(self, parser: str, table: str, **options: str) -> DataFrame:
        """Rows of a table in all files of a parser; the list of databases is that of the manifest."""
        f = self.files.where(F.col("parser") == parser).select("rel_path", "file_id")
        paths = [f"{self.path}/{r.rel_path}" for r in f.collect()]
        rows = sqlite.scan(self.case.spark, paths, table, wal="auto", **options)
        rel = F.substring("path", len(self.path) + 2, 1 << 30)
        return rows.withColumn("rel_path", rel).drop("path").join(f, "rel_path")

    def _rows(self) -> DataFrame:
        """Composers and bubbles as they are stored, and all other keys without their values."""
        r = self._scan("kv", "cursorDiskKV")
        ours = F.col("key").startswith("composerData:") | F.col("key").startswith("bubbleId:")
        rest = F.substring("key", 10, 1 << 20)
        bubble = F.col("key").startswith("bubbleId:") & F.contains(rest, F.lit(":"))
        kind = F.when(F.col("key").startswith("composerData:"), "composer").when(bubble, "bubble").when(F.col("key").startswith("bubbleId:"), "nameless").otherwise("other")
        composer = F.when(kind == "composer", F.substring("key", 14, 1 << 20)).when(kind == "bubble", F.split(rest, ":", 2)[0])
        doc = F.when(ours, F.make_valid_utf8(F.col("value").cast("string")))
        sound = F.coalesce(F.schema_of_variant(F.try_parse_json(doc)).startswith("OBJECT"), F.lit(False))
        return self.case.stage(r.select("file_id", "key", "size", "wal_applied", kind.alias("kind"), composer.alias("composer"), F.when(kind == "bubble", F.split(rest, ":", 2)[1]).alias("bubble"), F.when(ours, F.col("value")).alias("value"), F.when(sound, doc).alias("doc")))

    def _composers(self) -> DataFrame:
        """One row for each composer, also those that only bubbles name, with the list of bubbles that it holds."""
        c = self.rows.where("kind = 'composer'")
        get = lambda p: F.get_json_object("doc", p)
        listed = F.schema_of_variant(F.try_variant_get(F.try_parse_json("doc"), "$.fullConversationHeadersOnly", "variant")).startswith("ARRAY")
        inline = F.schema_of_variant(F.try_variant_get(F.try_parse_json("doc"), "$.conversation", "variant")).startswith("ARRAY")
        order = F.when(F.coalesce(listed, F.lit(False)), "list").when(F.coalesce(inline, F.lit(False)), "inline").otherwise("unknown")
        headers = F.from_json(get("$.fullConversationHeadersOnly"), "array<struct<bubbleId:string>>")["bubbleId"]
        own = c.select("file_id", "composer", "key", "doc", F.lit(0).alias("group"), order.alias("order"), headers.alias("headers"), F.from_json(get("$.conversation"), "array<string>").alias("inline"), text.json_text(F.col("doc"), "name").alias("title"), times.lenient(get("$.createdAt")).alias("created"), times.lenient(get("$.lastUpdatedAt")).alias("updated"))
        orphans = linking.missing(self.rows.where("kind = 'bubble'").select("file_id", "composer").distinct(), c, ["file_id", "composer"]).withColumn("group", F.lit(1)).withColumn("order", F.lit("unknown"))
        return self.case.stage(own.unionByName(orphans, allowMissingColumns=True))

    def _bubbles(self) -> DataFrame:
        """Bubbles in order, each with its document, its state and its turn."""
        key = ["file_id", "composer"]
        stored = self.rows.where("kind = 'bubble'").select(*key, "bubble", "key", "doc")
        listed = self.composers.where("`order` = 'list'").select(*key, F.posexplode("headers").alias("n", "bubble")).where("bubble is not null").groupBy(*key, "bubble").agg(F.min("n").cast("long").alias("n"))
        inline = self.composers.where("`order` = 'inline'").select(*key, F.concat(F.lit("composerData:"), "composer").alias("home"), F.posexplode("inline").alias("n", "doc")).withColumn("n", F.col("n").cast("long"))
        sound = F.coalesce(F.schema_of_variant(F.try_parse_json("doc")).startswith("OBJECT"), F.lit(False))
        inline = inline.select(*key, F.coalesce(text.json_text(F.col("doc"), "bubbleId"), F.lit("")).alias("bubble"), "n", F.col("home").alias("key"), F.concat(F.lit("#conversation["), F.col("n").cast("string"), F.lit("]")).alias("suffix"), F.when(sound, F.col("doc")).alias("doc"), F.lit("present").alias("state"))
        rest = linking.missing(stored, inline, [*key, "bubble"]).join(listed, [*key, "bubble"], "full").join(self.composers.select(*key, "order"), key)
        state = F.when(F.col("key").isNull(), "missing").when((F.col("order") != "unknown") & F.col("n").isNull(), "unreferenced").otherwise("present")
        every = rest.withColumn("state", state).drop("order").unionByName(inline, allowMissingColumns=True)
        get = lambda p: F.get_json_object("doc", p)
        role = F.when(get("$.type") == "1", "user").when(get("$.type") == "2", "assistant").otherwise("meta")
        w = Window.partitionBy(*key).orderBy(F.col("n").isNull(), "n", "bubble")
        placed = every.withColumn("role", F.when(F.col("doc").isNotNull(), role)).withColumn("n", F.row_number().over(w))
        shown = F.sum(F.col("doc").isNotNull().cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
        begins = F.when((F.col("role") == "user") & (F.col("state") != "unreferenced"), F.concat("composer", F.lit(":"), F.col("shown").cast("string")))
        turned = placed.withColumn("shown", shown).withColumn("turn", F.coalesce(F.last(begins, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.concat("composer", F.lit(":none"))))
        return self.case.stage(turned.join(self.composers.select(*key, "group"), key).withColumn("timestamp", times.lenient(get("$.createdAt"))))

    def _entries(self) -> DataFrame:
        """Entries of the local history with their place, and the hashes of the snapshots that they name and of those before them."""
        f = self.files.where("parser = 'local_history'").select("rel_path", "file_id")
        docs = contents(self.case, self.path, "entries.json").join(f, "rel_path").select("file_id", "rel_path", F.make_valid_utf8(F.col("content").cast("string")).alias("doc"))
        get = lambda p, t="string": F.try_variant_get(F.try_parse_json("e.text"), p, t)
        e = docs.select("file_id", "rel_path", text.file_uri_path(text.json_text(F.col("doc"), "resource")).alias("resource"), F.posexplode(spans.entry_spans_udf("doc")).alias("n", "e"))
        sound = F.coalesce(F.schema_of_variant(F.try_parse_json("e.text")).startswith("OBJECT"), F.lit(False))
        folder = F.element_at(F.split("rel_path", "/"), -2)
        e = e.select("file_id", "resource", F.col("n").cast("long").alias("n"), folder.alias("folder"), F.col("e.offset").alias("offset"), F.col("e.length").alias("length"), F.col("e.text").alias("doc"), sound.alias("sound"), F.coalesce(get("$.id"), F.lit("")).alias("entry"), times.from_millis(get("$.timestamp", "bigint")).alias("timestamp"), F.to_json(get("$.source", "variant")).alias("source"))
        e = e.withColumn("unsafe", text.unsafe_component(F.col("entry"))).withColumn("snapshot", F.when(~F.col("unsafe"), F.concat(F.lit("User/History/"), "folder", F.lit("/"), "entry")))
        known = self.files.where("kind = 'file'").select(F.col("rel_path").alias("snapshot"), "sha256", "version").union(self.case.table("source_files").where((F.col("root_id") == self.root_id) & (F.col("kind") == "file")).select("rel_path", "sha256", "version"))
        known = known.groupBy("snapshot").agg(F.max_by("sha256", "version").alias("after"))
        w = Window.partitionBy("file_id", "sound").orderBy("n")
        return self.case.stage(e.join(known, "snapshot", "left").withColumn("before", F.when(F.col("sound"), F.lag("after").over(w))))

    def _provenance(self) -> DataFrame:
        """One for each stored row, inline bubble and entry."""
        wal = F.when(F.col("wal_applied"), " +wal").otherwise("")
        rows = self.rows.where("kind in ('composer', 'bubble') and value is not null").select("file_id", F.lit("kv").alias("parser"), "key", F.lit("").alias("suffix"), F.lit(0).cast("long").alias("byte_offset"), F.col("size").cast("long").alias("byte_length"), F.sha2("value", 256).alias("content_sha256"), wal.alias("wal"))
        inline = self.bubbles.where("suffix is not null").select("file_id", "key", F.col("suffix").alias("more"))
        inline = rows.join(inline, ["file_id", "key"]).withColumn("suffix", F.col("more")).drop("more")
        kv = rows.unionByName(inline).withColumn("locator", F.concat(F.lit("cursorDiskKV:"), "key", "suffix", "wal")).drop("wal")
        e = self.entries.select("file_id", F.lit("local_history").alias("parser"), F.lit("").alias("key"), F.col("n").cast("string").alias("suffix"), F.col("offset").alias("byte_offset"), F.col("length").alias("byte_length"), F.sha2(F.col("doc").cast("binary"), 256).alias("content_sha256"))
        return self.case.stage(numbered(kv.unionByName(e, allowMissingColumns=True), ["byte_offset", "key", "suffix"], last_id(self.case, "provenance")))

    def _cited(self, rows: DataFrame) -> DataFrame:
        """rows (file_id, key, suffix) with the number of their provenance."""
        p = self.provenance.select("file_id", "key", F.col("suffix").alias("s"), F.col("id").alias("pid"))
        return rows.withColumn("s", F.coalesce("suffix", F.lit(""))).join(p, ["file_id", "key", "s"], "left").drop("s")

    def _sessions(self) -> DataFrame:
        fixed = F.col("created").isNotNull() & F.col("updated").isNotNull()
        c = self.composers.select("file_id", _place(F.col("group"), F.col("composer"), F.lit(0), F.lit(0)).alias("place"), F.col("composer").alias("harness_session_id"), F.when(F.col("group") == 0, "primary").otherwise("sidecar_only").alias("kind"), "title", F.when(fixed, F.col("created")).alias("first_ts"), F.when(fixed, F.col("updated")).alias("last_ts"), fixed.alias("bounds_from_adapter"))
        sound = self.entries.where("sound").groupBy("file_id").agg(F.min_by("timestamp", "n").alias("first_ts"), F.max_by("timestamp", "n").alias("last_ts"))
        h = self.files.where("parser = 'local_history'").select("file_id", F.concat(F.lit("history:"), F.element_at(F.split("rel_path", "/"), -2)).alias("harness_session_id"))
        h = h.join(self.entries.groupBy("file_id").agg(F.first("resource").alias("title")), "file_id", "left").join(sound, "file_id", "left")
        both = F.col("first_ts").isNotNull() & F.col("last_ts").isNotNull()
        h = h.withColumn("place", _place(F.lit(0), F.lit(""), F.lit(0), F.lit(0))).withColumn("kind", F.lit("local_history")).withColumn("bounds_from_adapter", both).withColumns({c: F.when(both, F.col(c)) for c in ("first_ts", "last_ts")})
        origin = F.when(F.col("bounds_from_adapter"), "stored").otherwise("absent")
        rows = numbered(c.unionByName(h), ["place"], last_id(self.case, "sessions")).withColumn("first_ts_origin", origin).withColumn("last_ts_origin", origin).withColumn("root_id", F.lit(self.root_id).cast("long"))
        return self.case.stage(rows.join(self.files.select("file_id", "store_id"), "file_id"))

    def _parts(self) -> DataFrame:
        """Bubbles with what their tool was given and gave."""
        b = self._cited(self.bubbles.where("doc is not null"))
        get = lambda p: F.get_json_object("doc", p)
        v = lambda p: F.try_variant_get(F.try_parse_json("doc"), p, "variant")
        kind = lambda p: F.schema_of_variant(v(p))
        there = lambda p: F.coalesce(kind(p) != "VOID", F.lit(False))
        tool = F.coalesce(kind("$.toolFormerData").startswith("OBJECT"), F.lit(False))
        raw = get("$.toolFormerData.rawArgs")
        broken = (kind("$.toolFormerData.rawArgs") == "STRING") & F.try_parse_json(raw).isNull()
        given = F.when(broken, _json(raw=raw)).when(there("$.toolFormerData.rawArgs"), raw).otherwise(get("$.toolFormerData.params"))
        own = lambda p: F.when(kind(p) == "STRING", get(p))
        answered = tool & (there("$.toolFormerData.result") | own("$.toolFormerData.status").isNotNull())
        s = self.sessions.select("file_id", F.col("harness_session_id").alias("composer"), F.col("id").alias("session_id"))
        return self.case.stage(b.join(s, ["file_id", "composer"]).select("*", tool.alias("tool"), F.coalesce(own("$.toolFormerData.name"), F.lit("")).alias("name"), own("$.toolFormerData.toolCallId").alias("call"), own("$.toolFormerData.status").alias("status"), F.when(there("$.toolFormerData.result"), get("$.toolFormerData.result")).alias("result"), F.when(tool, given).alias("input"), F.coalesce(tool & broken, F.lit(False)).alias("broken"), answered.alias("answered"), own("$.modelInfo.modelName").alias("model"), F.when(there("$.thinking"), get("$.thinking")).alias("thinking"), own("$.thinking.text").alias("thought"), own("$.text").alias("body"), F.from_json(get("$.images"), "array<string>").alias("images")))

    def _messages(self) -> DataFrame:
        stamped = lambda c: F.when(F.col(c).isNull(), "absent").otherwise("stored")
        s = self.sessions.select("file_id", F.col("harness_session_id").alias("composer"), F.col("id").alias("session_id"))
        c = self._cited(self.composers.where("doc is not null").withColumn("suffix", F.lit(""))).join(s, ["file_id", "composer"])
        c = c.select("file_id", "session_id", "pid", _place(F.col("group"), F.col("composer"), F.lit(0), F.lit(0)).alias("place"), F.lit("meta").alias("role"), F.lit("composerData").alias("record_type"), F.col("composer").alias("uuid"), F.col("created").alias("timestamp"), stamped("created").alias("timestamp_origin"), spans.without_udf("doc", F.lit("fullConversationHeadersOnly conversation")).alias("attributes"))
        turn = F.substring(_json(turn=F.col("turn")), 2, 1 << 30)
        kept = spans.without_udf("doc", F.lit("text thinking toolFormerData"))
        own = F.when(F.col("role") != "assistant", kept).when(kept == "{}", F.concat(F.lit("{"), turn)).otherwise(F.concat(F.regexp_replace(kept, r"\}$", ","), turn))
        at = lambda part: _place(F.col("group"), F.col("composer"), F.col("n"), F.lit(part)).alias("place")
        b = self.parts.select("file_id", "session_id", "pid", at(0), "role", F.lit("bubble").alias("record_type"), F.col("bubble").alias("uuid"), "timestamp", stamped("timestamp").alias("timestamp_origin"), "model", own.alias("attributes"))
        r = self.parts.where("answered").select("file_id", "session_id", "pid", at(1), F.lit("tool").alias("role"), F.lit("bubble.toolFormerData.result").alias("record_type"), F.col("bubble").alias("uuid"), "timestamp", stamped("timestamp").alias("timestamp_origin"), F.concat(F.lit("{"), turn).alias("attributes"))
        e = self._cited(self.entries.where("sound").select("*", F.lit("").alias("key"), F.col("n").cast("string").alias("suffix")))
        e = e.join(self.sessions.where("kind = 'local_history'").select("file_id", F.col("id").alias("session_id")), "file_id").select("file_id", "session_id", "pid", _place(F.lit(0), F.lit(""), F.col("n"), F.lit(0)).alias("place"), F.lit("meta").alias("role"), F.lit("local-history-entry").alias("record_type"), "timestamp", stamped("timestamp").alias("timestamp_origin"), spans.without_udf("doc", F.lit("id timestamp source")).alias("attributes"))
        rows = c
        for more in (b, r, e):
            rows = rows.unionByName(more, allowMissingColumns=True)
        rows = numbered(rows, ["place"], last_id(self.case, "messages"))
        return self.case.stage(rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy("session_id").orderBy("id")) - 1).cast("long")))

    def _blocks(self) -> DataFrame:
        shape = "array<struct<kind:string,text:string,payload:string,tool_use_id:string>>"
        block = lambda when, kind, body, payload, use=F.lit(None): F.when(when, F.array(F.struct(F.lit(kind), body.cast("string"), payload.cast("string"), use.cast("string")))).otherwise(F.array()).cast(shape)
        none = F.lit(None)
        name_ = F.get_json_object("doc", "$.toolFormerData")
        images = F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda i: F.struct(F.lit("image"), none.cast("string"), i, none.cast("string"))).cast(shape)
        used = F.concat(block(F.col("thinking").isNotNull(), "thinking", F.col("thought"), F.col("thinking")), block(F.coalesce(F.length("body") > 0, F.lit(False)), "text", F.col("body"), F.to_json(F.col("body").cast("variant"))), block(F.col("tool"), "tool_use", none, spans.without_udf(name_, F.lit("toolCallId result")), F.col("call")), images)
        at = lambda part: _place(F.col("group"), F.col("composer"), F.col("n"), F.lit(part)).alias("place")
        b = self.parts.select("file_id", at(0), F.posexplode(used).alias("ordinal", "b"))
        r = self.parts.where("answered").select("file_id", at(1), F.posexplode(block(F.lit(True), "tool_result", F.col("result"), _json(status=F.col("status"), result=F.col("result")), F.col("call"))).alias("ordinal", "b"))
        e = self.entries.where("sound").select("file_id", _place(F.lit(0), F.lit(""), F.col("n"), F.lit(0)).alias("place"), F.posexplode(block(F.lit(True), "attachment", none, _json(blob=F.col("after"), id=F.col("entry"), source=F.try_parse_json("source")))).alias("ordinal", "b"))
        rows = b.union(r).union(e).select("file_id", "place", F.col("ordinal").cast("long").alias("ordinal"), "b.*")
        m = self.messages.select("file_id", "place", F.col("id").alias("message_id"))
        return self.case.stage(numbered(rows.join(m, ["file_id", "place"]), ["place", "ordinal"], last_id(self.case, "blocks")))

    def _calls(self) -> DataFrame:
        at = lambda part: _place(F.col("group"), F.col("composer"), F.col("n"), F.lit(part))
        use = self.blocks.where("kind = 'tool_use'").select("file_id", F.col("place").alias("use_place"), F.col("id").alias("use_block"))
        result = self.blocks.where("kind = 'tool_result'").select("file_id", F.col("place").alias("result_place"), F.col("id").alias("result_block"))
        c = self.parts.where("tool").select("file_id", "session_id", at(0).alias("use_place"), at(1).alias("result_place"), "composer", "bubble", "name", text.editor_category(F.col("name")).alias("category"), "input", "status", "answered", F.col("result").alias("result_text"), F.coalesce(F.col("status") == "error", F.lit(False)).alias("is_error"), "timestamp")
        return self.case.stage(numbered(c.join(use, ["file_id", "use_place"]).join(result, ["file_id", "result_place"], "left"), ["use_place"], last_id(self.case, "tool_calls")))

    def _observations(self) -> DataFrame:
        from ..functions import secrets
        from ..sources import editor

        stamped = F.when(F.col("timestamp").isNull(), "absent").otherwise("stored").alias("timestamp_origin")
        given = self.calls.select("composer", F.col("id").cast("string").alias("bubble"), F.col("name").alias("tool"), "input", "status", "timestamp")
        done = editor.tool_observations(given).select(F.col("bubble").cast("long").alias("id"), "kind", "path", "command", "confidence")
        calls = done.join(self.calls.drop("kind"), "id").select("file_id", "session_id", "kind", F.col("id").alias("derived_from_tool_call_id"), "path", "command", "timestamp", stamped, "confidence", _json(tool=F.col("name")).alias("details"), F.lit(0).alias("rank"), F.col("id").alias("at"))
        own = self.sessions.where("kind = 'local_history'").select("file_id", F.col("id").alias("session_id"))
        e = self._cited(self.entries.where("sound").select("*", F.lit("").alias("key"), F.col("n").cast("string").alias("suffix"))).join(own, "file_id")
        e = e.select("file_id", "session_id", F.lit("file_written").alias("kind"), F.col("pid").alias("derived_from_provenance_id"), F.col("resource").alias("path"), F.col("before").alias("before_blob"), F.col("after").alias("after_blob"), "timestamp", stamped, F.lit("high").alias("confidence"), _json(id=F.col("entry"), source=F.try_parse_json("source")).alias("details"), F.lit(1).alias("rank"), F.col("n").alias("at"))
        hit = lambda field: _json(rule=F.col("m.rule"), rule_version=F.lit("1"), field=field, offset=F.col("m.offset"), length=F.col("m.length"), match=F.col("m.match")).alias("details")
        m = self.messages.select(F.col("id").alias("message_id"), "session_id", "timestamp", "timestamp_origin")
        b = secrets.scan(self.blocks.join(m, "message_id"), F.col("text"), "file_id", "session_id", "id", "kind", "timestamp", "timestamp_origin").select("file_id", "session_id", F.lit("secret_candidate").alias("kind"), F.col("id").alias("derived_from_block_id"), "timestamp", "timestamp_origin", F.col("m.confidence").alias("confidence"), hit(F.col("kind")), F.lit(2).alias("rank"), F.col("id").alias("at"))
        c = secrets.scan(self.calls, F.col("input"), "file_id", "session_id", "id", "timestamp").select("file_id", "session_id", F.lit("secret_candidate").alias("kind"), F.col("id").alias("derived_from_tool_call_id"), "timestamp", stamped, F.col("m.confidence").alias("confidence"), hit(F.lit("tool_input")), F.lit(3).alias("rank"), F.col("id").alias("at"))
        out = calls
        for more in (e, b, c):
            out = out.unionByName(more, allowMissingColumns=True)
        return numbered(out, ["rank", "at", "details"], last_id(self.case, "observations"))

    def _workspaces(self) -> DataFrame:
        """Composers that workspaces list, with the workspace's folder and the session, if there is one."""
        rows = self._scan("workspace", "ItemTable").where("key = 'composer.composerData'")
        ids = F.from_json(F.make_valid_utf8(F.col("value").cast("string")), "allComposers array<struct<composerId:string>>")["allComposers"]["composerId"]
        folder = F.element_at(F.split("rel_path", "/"), -2)
        listed = rows.select("file_id", folder.alias("workspace"), F.explode(ids).alias("composer")).where("composer is not null")
        docs = contents(self.case, self.path, "workspace.json").where(F.col("length") <= MOST_BYTES).select(F.element_at(F.split("rel_path", "/"), -2).alias("workspace"), F.make_valid_utf8(F.col("content").cast("string")).alias("doc"))
        where = docs.select("workspace", text.file_uri_path(F.coalesce(text.json_text(F.col("doc"), "folder"), text.json_text(F.col("doc"), "workspace"))).alias("folder"))
        all_ = self.case.table("sessions").where(F.col("root_id") == self.root_id).groupBy(F.col("harness_session_id").alias("composer")).agg(F.min("id").alias("session_id"))
        return self.case.stage(listed.join(where, "workspace", "left").join(all_, "composer", "left"))

    def _anomalies(self, drift: DataFrame, listed: DataFrame) -> DataFrame:
        """What is odd, in files, rows, lists and fields."""
        s = self.sessions.select("file_id", F.col("harness_session_id").alias("composer"), F.col("id").alias("session_id"))
        kind = lambda k: F.lit(k).alias("kind")
        b = self._cited(self.bubbles).join(s, ["file_id", "composer"])
        missing = b.where("state = 'missing'").select("file_id", "session_id", kind("missing_transcript"), F.lit("info").alias("given"), _json(composer=F.col("composer"), bubble=F.col("bubble")).alias("details"))
        extra = b.where("state = 'unreferenced'").select("file_id", "session_id", "pid", kind("unreferenced_record"), _json(composer=F.col("composer"), bubble=F.col("bubble")).alias("details"))
        broken = b.where("state <> 'missing' and doc is null").select("file_id", "session_id", "pid", kind("malformed_record"), _json(composer=F.col("composer"), bubble=F.col("bubble")).alias("details"))
        strange = b.where("role = 'meta'").select("file_id", "session_id", "pid", kind("unknown_record_type"), _json(type=F.try_variant_get(F.try_parse_json("doc"), "$.type", "variant")).alias("details"))
        untimed = b.where("doc is not null and timestamp is null").groupBy("file_id", "session_id", "composer").agg(F.count("*").alias("n"), F.min_by("pid", "n").alias("pid")).select("file_id", "session_id", "pid", kind("missing_timestamp"), _json(composer=F.col("composer"), count=F.col("n")).alias("details"))
        raw = self.parts.where("broken").select("file_id", "session_id", "pid", kind("malformed_record"), F.lit("info").alias("given"), _json(bubble=F.col("bubble")).alias("details"))
        fields = self.parts.select("file_id", "pid", F.explode(F.json_object_keys("doc")).alias("field")).where(~F.col("field").isin(*BUBBLE_FIELDS)).groupBy("file_id", "field").agg(F.count("*").alias("n"), F.min("pid").alias("pid")).select("file_id", "pid", kind("unknown_field"), _json(record_kind=F.lit("bubble"), field=F.col("field"), count=F.col("n")).alias("details"))
        lone = self.composers.where("`group` = 1").join(s, ["file_id", "composer"]).select("file_id", "session_id", kind("missing_transcript"), _json(composer=F.col("composer")).alias("details"))
        bad = self._cited(self.composers.where("`group` = 0 and doc is null").withColumn("suffix", F.lit(""))).select("file_id", "pid", kind("malformed_record"), _json(composer=F.col("composer")).alias("details"))
        nameless = self.rows.where("kind = 'nameless'").groupBy("file_id").agg(F.count("*").alias("n"), F.min("key").alias("first")).select("file_id", kind("malformed_record"), F.lit("warning").alias("given"), _json(count=F.col("n"), first_key=F.col("first")).alias("details"))
        prefix = F.when(F.contains("key", F.lit(":")), F.substring_index("key", ":", 1)).otherwise("")
        other = self.rows.where("kind = 'other'").groupBy("file_id", prefix.alias("prefix")).agg(F.count("*").alias("n")).select("file_id", kind("unknown_record_type"), _json(prefix=F.col("prefix"), count=F.col("n"), parsed=F.lit(False)).alias("details"))
        wal = self.rows.where("wal_applied").select("file_id", kind("wal_applied"), F.lit("{}").alias("details")).distinct()
        e = self._cited(self.entries.select("*", F.lit("").alias("key"), F.col("n").cast("string").alias("suffix"))).join(self.sessions.where("kind = 'local_history'").select("file_id", F.col("id").alias("session_id")), "file_id")
        named = _json(history=F.col("folder"), id=F.col("entry")).alias("details")
        skipped = e.where("not sound").select("file_id", "session_id", "pid", kind("malformed_record"), _json(history=F.col("folder"), index=F.col("n")).alias("details"))
        unsafe = e.where("sound and unsafe").select("file_id", "session_id", "pid", kind("suspicious_path"), named)
        absent = e.where("sound and not unsafe and after is null").select("file_id", "session_id", "pid", kind("missing_transcript"), F.lit("info").alias("given"), named)
        gone = listed.where("session_id is null").select("file_id", kind("missing_transcript"), F.lit("info").alias("given"), _json(composer=F.col("composer"), workspace=F.col("workspace")).alias("details"))
        links = self.files.where("kind = 'symlink'").select("file_id", kind("symlink_in_evidence"), F.lit("{}").alias("details")).unionByName(self.files.where("encoded").select("file_id", kind("non_utf8_path"), _json(rel_path=F.col("rel_path")).alias("details")))
        moved = drift.select("file_id", kind("hash_drift"), _json(version=F.col("version")).alias("details"))
        out = missing
        for more in (extra, broken, strange, untimed, raw, fields, lone, bad, nameless, other, wal, skipped, unsafe, absent, gone, links, moved):
            out = out.unionByName(more, allowMissingColumns=True)
        severity = F.lit("warning")
        for k, v in SEVERITIES.items():
            severity = F.when(F.col("kind") == k, v).otherwise(severity)
        rows = numbered(out, ["session_id", "kind", "details"], last_id(self.case, "anomalies"))
        return rows.join(self.files.select("file_id", "rel_path"), "file_id").select("id", F.lit(self.root_id).alias("root_id"), F.col("file_id").alias("source_file_id"), "session_id", F.col("pid").alias("provenance_id"), "kind", F.coalesce("given", severity).alias("severity"), F.concat(F.replace("kind", F.lit("_"), F.lit(" ")), F.lit(" in "), "rel_path").alias("message"), "details")

    def _write(self, drift: DataFrame) -> None:
        case = self.case
        counts = self.rows.where("kind in ('composer', 'bubble')").select("file_id").unionAll(self.entries.select("file_id")).groupBy("file_id").agg(F.count("*").alias("record_count"))
        write_files(case, self.files, counts)
        parser = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in PARSERS.items() for x in (k, v[i]))), F.col("parser"))
        case.append("provenance", self.provenance.withColumnRenamed("file_id", "source_file_id").withColumn("parser_version", parser(1)).withColumn("parser", parser(0)).withColumn("origin", F.lit("stored")))
        case.append("messages", self.messages.withColumnRenamed("pid", "provenance_id"))
        calls = self.calls.select("id", F.explode(F.filter(F.array("use_block", "result_block"), lambda x: x.isNotNull())).alias("block")).groupBy("block").agg(F.max("id").alias("tool_call_id"))
        case.append("blocks", self.blocks.join(calls.withColumnRenamed("block", "id"), "id", "left"))
        case.append("tool_calls", self.calls.withColumnsRenamed({"use_block": "tool_use_block_id", "result_block": "tool_result_block_id"}))
        case.append("observations", self._observations())
        case.append("sessions", self.sessions)
        claims = self.sessions.where("kind <> 'local_history'").select("file_id", F.col("id").alias("session_id"), F.lit("cursor:composerId").alias("scheme"), F.col("harness_session_id").alias("claimed_id"), F.lit("unmatched").alias("join_status"))
        case.append("identity_claims", numbered(claims, ["session_id"], last_id(case, "identity_claims")))
        listed = self._workspaces()
        case.append("anomalies", self._anomalies(drift, listed))
        where = listed.where("session_id is not null and folder is not null").groupBy(F.col("session_id").alias("id")).agg(F.min_by("folder", "file_id").alias("folder"))
        case.replace("sessions", case.table("sessions").join(where, "id", "left").withColumn("project_path", F.coalesce("project_path", "folder")))
        snapshots = contents(case, self.path).join(self.entries.where("sound").select(F.col("snapshot").alias("rel_path")).distinct(), "rel_path", "left_semi")
        case.put_blobs(self.rows.where("value is not null").select(F.col("value").alias("content")).union(snapshots.select("content")))


def join_claims(case) -> None:
    """Every claim of an editor's session anew, over all roots: the sessions that claim the same or bear the claimed name."""
    claims = case.table("identity_claims")
    ours = claims.where(F.col("scheme").startswith("cursor:")).select("id", F.col("session_id").alias("session"), "scheme", F.col("claimed_id").alias("claimed"))
    roots = case.table("evidence_roots").where("harness in ('cursor', 'cursor-ide')").select(F.col("id").alias("root_id"))
    editors = case.table("sessions").join(roots, "root_id", "left_semi").select("id", F.col("harness_session_id").alias("name"))
    known = ours.join(editors.select(F.col("id").alias("session")), "session", "left_semi")
    found = case.stage(linking.resolve(ours, linking.claim_candidates(known, editors)).select("id", "status"))
    case.replace("identity_claims", claims.join(found, "id", "left").withColumn("join_status", F.coalesce("status", "join_status")))
