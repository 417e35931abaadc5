"""Takes the directory of an editor's agent into a case: its transcripts, which bear no times, the files beside them that hold results, and its chat stores.

A session has no first time and ends with the file's. Where a call has no id it gets no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import secrets, spans, text
from ..operators import tools
from ..sources import editor, jsonl, transcripts
from .ingest import SEVERITIES, _json, contents, finish, last_id, numbered, numbered_by, take_up, write_files
from .ingest_chats import PARSER as CHAT_PARSER
from .ingest_chats import ChatLoad
from .ingest_editor import join_claims

# Stores of a root in the order in which they are read.
STORES = {"cursor:agent-transcripts": "projects", "cursor:chat-store": "chats", "cursor:acp-sessions": "acp-sessions", "cursor:ai-tracking": "ai-tracking", "cursor:prompt-history": "prompt_history.json"}
PARSER = ("cursor-transcript", "1")
PATH = r"^projects/(?:.*/)?agent-transcripts/(?:([^/]+)\.jsonl|([^/]+)/(\2)\.jsonl|([^/]+)/subagents/([^/]+)\.jsonl)$"


def parser_of(path: Column, kind: Column) -> Column:
    return F.when(kind == "symlink", None).when(path.rlike(PATH), "transcript").when(path.rlike(r"^chats/(?:.*/)?store\.db$"), "chat")


def ingest(case, path: str, label: str) -> int:
    """Takes up what is new below path, an agent's directory, under a label; gives the root's id."""
    return take_up(case, path, label, "cursor", STORES, parser_of, AgentLoad)


class AgentLoad:
    """The plans of one ingest. Each table is written once and read again by what builds on it."""

    def __init__(self, case, root_id: int, path: str, files: DataFrame):
        self.case, self.root_id, self.path, self.files = case, root_id, path, files

    def run(self, drift: DataFrame) -> None:
        f = self.files.where("parser = 'transcript'").select(F.col("rel_path").alias("path"), "file_id")
        lines = jsonl.parsed(jsonl.records(jsonl.lines(self.case.spark, self.path, "*.jsonl").join(f, "path", "left_semi"))).drop("content")
        self.records = self.case.stage(numbered_by(lines.join(f, "path"), "nth", last_id(self.case, "provenance")).withColumnRenamed("id", "pid"))
        sound = self.records.where("anomaly is null or anomaly = 'invalid_utf8'").where(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"))
        timeless = F.lit(None).cast("string")
        self.lines = self.case.stage(transcripts.fields(sound, "pid", "file_id").withColumn("session", F.col("path")).withColumn("given", text.json_text(F.col("text"), "role")).withColumn("timestamp", timeless).withColumn("outcome", timeless))
        self.found = self.case.stage(transcripts.blocks(self.lines.withColumn("record_type", F.lit("assistant"))))
        self.sessions = self._sessions()
        self.messages = self._messages()
        m = self.messages.select("path", "index", F.col("id").alias("message_id"), "file_id", "session_id")
        self.blocks = self.case.stage(numbered(self.found.join(m, ["path", "index"]), ["index", "ordinal"], last_id(self.case, "blocks")))
        self.calls = self._calls()
        self.chats = None if self.files.where("parser = 'chat'").isEmpty() else ChatLoad(self.case, self.root_id, self.path, self.files)
        self._write(drift)
        if self.chats:
            self._write_chats()
        finish(self.case, self.root_id)
        join_claims(self.case)

    def _sessions(self) -> DataFrame:
        part = lambda i: F.regexp_extract("rel_path", PATH, i)
        parent = F.when(part(4) != "", part(4))
        own = F.when(part(1) != "", part(1)).when(part(2) != "", part(2)).otherwise(part(5))
        slug = F.regexp_extract("rel_path", r"([^/]+)/agent-transcripts/", 1)
        folder = F.concat(F.regexp_extract("rel_path", r"^(.*agent-transcripts/)", 1), F.coalesce(parent, own), F.lit("/agent-tools/"))
        rows = self.files.where("parser = 'transcript'").select("file_id", "store_id", F.lit(self.root_id).cast("long").alias("root_id"), F.col("rel_path").alias("path"), own.alias("harness_session_id"), parent.alias("parent_harness_session_id"), F.when(parent.isNull(), "primary").otherwise("subagent").alias("kind"), slug.alias("project_path"), folder.alias("folder"), F.lit("absent").alias("first_ts_origin"), F.col("mtime").alias("last_ts"), F.when(F.col("mtime").isNull(), "absent").otherwise("file_mtime").alias("last_ts_origin"), F.lit(True).alias("bounds_from_adapter"))
        return self.case.stage(numbered(rows, ["path"], last_id(self.case, "sessions")))

    def _messages(self) -> DataFrame:
        """Lines as messages, each with the turn that it belongs to; what a prompt wraps stands in its attributes."""
        s = self.sessions.select("path", F.col("id").alias("session_id"), F.col("harness_session_id").alias("hsid"))
        shape = self.found.groupBy("path", "index").agg(F.bool_and(F.col("kind") == "tool_result").alias("results"), F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("ordinal", "text")))).alias("texts"))
        rows = self.lines.join(s, "path").join(shape, ["path", "index"], "left")
        role = F.when(F.col("given").isin("user", "assistant"), F.col("given")).otherwise("meta")
        only = F.coalesce("results", F.lit(False))
        rows = rows.withColumn("role", role).withColumn("begins", (F.col("role") == "user") & ~only)
        w = Window.partitionBy("path").orderBy("index")
        turn = F.coalesce(F.last(F.when(F.col("begins"), F.concat("hsid", F.lit(":"), F.col("index").cast("string"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.concat("hsid", F.lit(":none")))
        wrapped = r"(?s)^\s*(?:<timestamp>([^<]*)</timestamp>\s*)?<user_query>(.*)</user_query>\s*$"
        body = F.array_join(F.transform("texts", lambda t: t["text"]), "\n")
        at = F.when(body.contains("<timestamp>"), text.strip(F.regexp_extract(body, wrapped, 1)))
        query = F.when((F.col("given") == "user") & body.rlike(wrapped), F.to_json(F.struct(F.struct(text.strip(F.regexp_extract(body, wrapped, 2)).alias("text"), at.alias("embedded_timestamp"), spans.embedded_time_udf(at).alias("embedded_timestamp_utc")).alias("user_query"))))
        own = F.when((F.col("role") != "meta") & ~F.col("begins"), F.to_json(F.struct(turn.alias("turn"))))
        kept = F.when(F.col("role") == "meta", spans.attributes_udf("text")).otherwise(spans.without_udf(spans.attributes_udf("text"), F.lit("role")))
        inner = lambda c: F.substring(c, 2, F.length(c) - 2)
        parts = F.filter(F.array(inner(kept), inner(query), inner(own)), lambda x: x.isNotNull() & (F.length(x) > 0))
        rows = rows.withColumn("attributes", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))
        rows = rows.withColumn("role", F.when((F.col("role") == "user") & only, "tool").otherwise(F.col("role"))).withColumn("record_type", F.when(F.length("given") > 0, F.col("given")).otherwise("line"))
        rows = numbered(rows.select("path", "index", "pid", "file_id", "session_id", "role", "record_type", "model", "attributes", "given", F.lit("absent").alias("timestamp_origin")), ["index"], last_id(self.case, "messages"))
        return self.case.stage(rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy("session_id").orderBy("id")) - 1).cast("long")))

    def _calls(self) -> DataFrame:
        """Calls in the order in which they are given out, with the file that holds a result beside the transcript."""
        position = F.struct("index", "ordinal")
        paired = transcripts.tool_calls(self.found).select("path", "tool_use_id", "use_position", "result_position", "name", "input", "result_text", "is_error")
        uses = self.found.where("kind = 'tool_use'")
        again = uses.where("tool_use_id is not null").select("path", position.alias("use_position"), F.lead(position).over(Window.partitionBy("path", "tool_use_id").orderBy("index", "ordinal")).alias("displaced"))
        bare = uses.where("tool_use_id is null").select("path", position.alias("use_position"), position.alias("displaced"), "name", "input", F.lit(False).alias("is_error"))
        rows = paired.join(again, ["path", "use_position"]).unionByName(bare, allowMissingColumns=True).withColumn("at", F.coalesce("result_position", "displaced"))
        b = self.blocks.select("path", position.alias("use_position"), F.col("id").alias("use_block"), "file_id", "session_id")
        r = self.blocks.select("path", position.alias("result_position"), F.col("id").alias("result_block"))
        s = self.sessions.select("path", "folder")
        rows = rows.join(b, ["path", "use_position"]).join(r, ["path", "result_position"], "left").join(s, "path")
        rows = rows.withColumn("unsafe", F.coalesce(text.unsafe_component(F.col("tool_use_id")), F.lit(False))).withColumn("rel_path", F.when(F.col("tool_use_id").isNotNull() & ~F.col("unsafe"), F.concat("folder", "tool_use_id", F.lit(".txt"))))
        side = self.files.where("kind = 'file'").select("rel_path", "sha256").union(self.case.table("source_files").where((F.col("root_id") == self.root_id) & (F.col("kind") == "file")).select("rel_path", "sha256")).groupBy("rel_path").agg(F.max("sha256").alias("side"))
        rows = rows.join(side, "rel_path", "left").withColumn("name", F.coalesce("name", F.lit(""))).withColumn("result_payload", F.when(F.col("side").isNotNull(), _json(sidecar_blob=F.col("side")))).withColumn("category", text.editor_category(F.col("name")))
        return self.case.stage(numbered(rows, [F.col("at").asc_nulls_last(), "use_position"], last_id(self.case, "tool_calls")))

    def _observations(self, every_call: DataFrame, blocks: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        status = F.when(F.col("result_block").isNotNull() & ~F.col("is_error"), "completed")
        done = editor.tool_observations(every_call.select(none.alias("composer"), F.col("id").cast("string").alias("bubble"), F.col("name").alias("tool"), "input", status.alias("status"), none.alias("timestamp"))).select(F.col("bubble").cast("long").alias("id"), "kind", "path", "command", "confidence")
        calls = done.join(every_call.select("id", "file_id", "session_id", "name"), "id").select("file_id", "session_id", "kind", F.col("id").alias("derived_from_tool_call_id"), "path", "command", "confidence", _json(tool=F.col("name")).alias("details"), F.lit(0).alias("rank"), F.col("id").alias("at"))
        hit = lambda field: _json(rule=F.col("m.rule"), rule_version=F.lit("1"), field=field, offset=F.col("m.offset"), length=F.col("m.length"), match=F.col("m.match")).alias("details")
        secret = F.lit("secret_candidate").alias("kind")
        b = secrets.scan(blocks, F.col("text"), "file_id", "session_id", "id", "kind").select("file_id", "session_id", secret, F.col("id").alias("derived_from_block_id"), F.col("m.confidence").alias("confidence"), hit(F.col("kind")), F.lit(1).alias("rank"), F.col("id").alias("at"))
        c = secrets.scan(every_call, F.col("input"), "file_id", "session_id", "id").select("file_id", "session_id", secret, F.col("id").alias("derived_from_tool_call_id"), F.col("m.confidence").alias("confidence"), hit(F.lit("tool_input")), F.lit(2).alias("rank"), F.col("id").alias("at"))
        return numbered(calls.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True).withColumn("timestamp_origin", F.lit("absent")), ["rank", "at", "details"], last_id(self.case, "observations"))

    def _anomalies(self, drift: DataFrame) -> DataFrame:
        s = self.sessions.select("path", F.col("id").alias("session_id"))
        kind = lambda k: F.lit(k).alias("kind")
        r = self.records.join(s, "path")
        bad = r.where("anomaly is not null").select("file_id", "session_id", "pid", F.col("anomaly").alias("kind"), F.lit("{}").alias("details"))
        flat = r.join(self.lines.select("pid"), "pid", "left_anti").where("anomaly is null").select("file_id", "session_id", "pid", kind("malformed_record"), F.lit("{}").alias("details"))
        strange = self.messages.where("role = 'meta'").select("file_id", "session_id", "pid", kind("unknown_record_type"), _json(role=F.col("given")).alias("details"))
        stream = self.found.where("kind in ('tool_use', 'tool_result') and tool_use_id is not null").select(F.struct("path", "tool_use_id").alias("key"), F.struct("index", "ordinal").alias("position"), F.when(F.col("kind") == "tool_use", "use").otherwise("result").alias("kind"))
        at = self.messages.select("path", "index", "file_id", "session_id", "pid")
        lone = tools.pair(stream).where("status = 'unpaired'").select("key.path", "result_position.index", "key.tool_use_id").join(at, ["path", "index"]).select("file_id", "session_id", "pid", kind("unpaired_tool_result"), _json(tool_use_id=F.col("tool_use_id")).alias("details"))
        unsafe = self.calls.where("unsafe").select("file_id", "session_id", kind("suspicious_path"), _json(tool_use_id=F.col("tool_use_id")).alias("details"))
        reason = F.when(F.col("kind") == "other", "unknown_type").when(F.col("kind").isin("tool_use", "tool_result") & F.col("tool_use_id").isNull(), "missing_id")
        named = F.coalesce(F.when(F.length(text.json_text(F.col("payload"), "type")) > 0, text.json_text(F.col("payload"), "type")), F.lit("(no type)"))
        census = self.found.withColumn("reason", reason).where("reason is not null").join(at, ["path", "index"]).groupBy("file_id", "session_id", named.alias("block_type"), "reason").agg(F.count("*").alias("n"), F.min("pid").alias("pid"))
        given = F.when((F.col("reason") == "missing_id") & (F.col("block_type") == "tool_use"), "info").otherwise("warning").alias("given")
        census = census.select("file_id", "session_id", "pid", kind("unknown_record_type"), given, _json(record_kind=F.lit("content_block"), block_type=F.col("block_type"), reason=F.col("reason"), count=F.col("n")).alias("details"))
        links = self.files.where("kind = 'symlink'").select("file_id", kind("symlink_in_evidence"), F.lit("{}").alias("details")).unionByName(self.files.where("encoded").select("file_id", kind("non_utf8_path"), _json(rel_path=F.col("rel_path")).alias("details")))
        moved = drift.select("file_id", kind("hash_drift"), _json(version=F.col("version")).alias("details"))
        out = bad
        for more in (flat, strange, lone, unsafe, census, links, moved):
            out = out.unionByName(more, allowMissingColumns=True)
        return self._told(out)

    def _told(self, odd: DataFrame) -> DataFrame:
        """Anomalies as rows of their table."""
        severity = F.lit("warning")
        for k, v in SEVERITIES.items():
            severity = F.when(F.col("kind") == k, v).otherwise(severity)
        rows = numbered(odd, ["pid", "kind", "details"], last_id(self.case, "anomalies"))
        return rows.join(self.files.select("file_id", "rel_path"), "file_id").select("id", F.lit(self.root_id).alias("root_id"), F.col("file_id").alias("source_file_id"), "session_id", F.col("pid").alias("provenance_id"), "kind", F.coalesce("given", severity).alias("severity"), F.concat(F.replace("kind", F.lit("_"), F.lit(" ")), F.lit(" in "), "rel_path").alias("message"), "details")

    def _write(self, drift: DataFrame) -> None:
        case = self.case
        files, records = self.files, self.records.select("file_id")
        if self.chats:
            self.chats.read()
            files = files.join(self.chats.whole.select("file_id", F.lit(True).alias("store_read")), "file_id", "left").withColumn("parser", F.when((F.col("parser") != "chat") | F.col("store_read"), F.col("parser"))).drop("store_read")
            records = records.unionAll(self.chats.records.select("file_id"))
        write_files(case, files, records.groupBy("file_id").agg(F.count("*").alias("record_count")))
        case.append("provenance", self.records.where("not oversized").select(F.col("pid").alias("id"), F.col("file_id").alias("source_file_id"), F.col("offset").alias("byte_offset"), F.col("length").alias("byte_length"), F.col("sha256").alias("content_sha256"), F.lit(PARSER[0]).alias("parser"), F.lit(PARSER[1]).alias("parser_version"), F.lit("stored").alias("origin")))
        self._write_spoken(self)
        case.append("observations", self._observations(self.calls, self.blocks))
        case.append("sessions", self.sessions)
        claims = self.sessions.select("file_id", F.col("id").alias("session_id"), F.lit("cursor:composerId").alias("scheme"), F.col("harness_session_id").alias("claimed_id"), F.lit("unmatched").alias("join_status"))
        case.append("identity_claims", numbered(claims, ["session_id"], last_id(case, "identity_claims")))
        case.append("anomalies", self._anomalies(drift))
        side = self.calls.where("side is not null").select("rel_path").distinct()
        case.put_blobs(contents(case, self.path, "*.txt").join(side, "rel_path", "left_semi").select("content"))

    def _write_spoken(self, load) -> None:
        """Messages, blocks and calls."""
        case = self.case
        case.append("messages", load.messages.withColumnRenamed("pid", "provenance_id"))
        calls = load.calls.select("id", F.explode(F.filter(F.array("use_block", "result_block"), lambda x: x.isNotNull())).alias("block")).groupBy("block").agg(F.max("id").alias("tool_call_id"))
        case.append("blocks", load.blocks.join(calls.withColumnRenamed("block", "id"), "id", "left"))
        case.append("tool_calls", load.calls.withColumnsRenamed({"use_block": "tool_use_block_id", "result_block": "tool_result_block_id"}))

    def _write_chats(self) -> None:
        """Chat stores follow the transcripts, as their files do."""
        case, chats = self.case, self.chats
        chats.run()
        case.append("provenance", chats.provenance.select("id", F.col("file_id").alias("source_file_id"), "byte_offset", "byte_length", "locator", "content_sha256", F.lit(CHAT_PARSER[0]).alias("parser"), F.lit(CHAT_PARSER[1]).alias("parser_version"), "origin"))
        self._write_spoken(chats)
        case.append("observations", self._observations(chats.calls, chats.blocks))
        case.append("sessions", chats.sessions)
        case.append("identity_claims", chats.claims())
        case.append("anomalies", self._told(chats.anomalies()))
        case.put_blobs(chats.kept())
