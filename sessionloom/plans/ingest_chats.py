"""Takes the chat stores of an editor's agent into a case: blobs by hash, which form a tree below the root that a header names.

Blobs stand depth first from the root, those that it does not reach after them in the order of their rows. A blob that is a JSON
object with a role is a message, and a second one where it holds results of tools; of other blobs the texts are kept, marked as
derived. Nodes of the tree are counted alone. The order within one store is found in one task from hashes and rows; contents stay
in the table. Blobs above the cap of the source are named by an anomaly and left out; a file that is no such store is only listed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spans, text, times, wire
from ..operators import tools, trees
from ..sources import sqlite
from .ingest import _json, last_id, numbered

# The parser's name and version, the fields of a message that are known, and the tables of a store.
PARSER = ("cursor-chat-store", "1")
MESSAGE_FIELDS = ["role", "content", "id"]
TABLES = ["meta", "blobs"]
BLOCKS = "array<struct<kind:string,text:string,payload:string,tool_use_id:string>>"


@F.pandas_udf(T.StructType().add("tree", T.BooleanType()).add("refs", T.ArrayType(T.StringType())))
def _shape(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"tree": [x is not None and wire.is_tree_node(x) for x in data], "refs": [[] if x is None else wire.references(x) for x in data]})


@F.pandas_udf(T.StringType())
def _texts(data: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or not (found := wire.strings(x)) else "\n".join(found) for x in data], dtype=object)


def _utf8(data: Column) -> Column:
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))


def _own(value: Column, path: str) -> Column:
    """A member of a variant if it is a string."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def _block(p: Column) -> Column:
    """The block of one part of a message's content."""
    kind, none = F.coalesce(_own(p, "$.type"), F.lit("")), F.lit(None).cast("string")
    part = lambda path: F.try_variant_get(p, path, "variant")
    result = F.when(F.schema_of_variant(part("$.result")) != "VOID", F.coalesce(_own(p, "$.result"), F.to_json(part("$.result"))))
    whole = F.coalesce(F.to_json(p), F.lit("null"))
    named = F.when(kind == "text", "text").when(kind == "reasoning", "thinking").when(kind == "tool-call", "tool_use").when(kind == "tool-result", "tool_result").otherwise("other")
    body = F.when(kind.isin("text", "reasoning"), _own(p, "$.text")).when(kind == "tool-result", result)
    payload = F.when(kind.isin("text", "reasoning"), "null").when(kind == "tool-call", _json(name=part("$.toolName"), input=part("$.args"))).otherwise(whole)
    return F.struct(named.alias("kind"), body.alias("text"), payload.alias("payload"), F.when(kind.isin("tool-call", "tool-result"), _own(p, "$.toolCallId")).otherwise(none).alias("tool_use_id"))


class ChatLoad:
    """The plans of one ingest. Each table is written once and read again by what builds on it."""

    def __init__(self, case, root_id: int, path: str, files: DataFrame):
        self.case, self.root_id, self.path, self.files = case, root_id, path, files.where("parser = 'chat'")

    def read(self) -> None:
        here = sqlite.tables_udf(F.concat(F.lit(self.path + "/"), "rel_path"), F.lit(" ".join(TABLES)))
        self.stores = self.case.stage(self.files.select("file_id", "store_id", "rel_path", "mtime", here.alias("tables")))
        self.whole = self.stores.where(F.size("tables") == len(TABLES))
        self.heads = self._heads()
        self.head = self.case.stage(self.whole.select("file_id").join(self.heads.where("doc is not null").groupBy("file_id").agg(F.min_by(F.struct("key", "doc", "value", "size"), "row").alias("h")), "file_id", "left").select("file_id", "h.*"))
        self.rows = self._rows()
        self.order = self._order()
        self.records = self.case.stage(self.order.where("state <> 'oversized'").select("file_id", "position").unionAll(self.head.where("doc is not null").select("file_id", F.lit(-1).cast("long"))))

    def run(self) -> None:
        self.sessions = self._sessions()
        self.said = self._said()
        self.provenance = self._provenance()
        self.messages = self._messages()
        self.blocks = self._blocks()
        self.calls = self._calls()

    def _scan(self, table: str, **options: str) -> DataFrame:
        """Rows of a table in all stores, with the text of what is null as empty; the list of databases is that of the manifest."""
        f = self.whole.select("rel_path", "file_id")
        rows = sqlite.scan(self.case.spark, [f"{self.path}/{r.rel_path}" for r in f.collect()], table, wal="auto", **options)
        value = F.when(F.col("size").isNull(), F.encode(F.lit(""), "UTF-8")).otherwise(F.col("value"))
        return rows.withColumn("rel_path", F.substring("path", len(self.path) + 2, 1 << 30)).drop("path").join(f, "rel_path").withColumn("value", value).withColumn("key", F.coalesce("key", F.lit("")))

    def _heads(self) -> DataFrame:
        """Rows of the table meta; doc where one is the hex of a JSON object."""
        digits = text.strip(_utf8(F.col("value")))
        raw = F.when(digits.rlike("^[0-9A-Fa-f]*$") & (F.length(digits) % 2 == 0), F.unhex(digits))
        doc = _utf8(raw)
        kind = F.schema_of_variant(F.try_parse_json(doc))
        reason = F.when(F.col("value").isNull(), "large").when(raw.isNull(), "not hex").when(kind.isNull(), "not JSON").when(~kind.startswith("OBJECT"), "not an object")
        return self.case.stage(self._scan("meta").select("file_id", "row", "key", "size", "value", "wal_applied", reason.alias("reason"), F.when(kind.startswith("OBJECT"), doc).alias("doc")))

    def _rows(self) -> DataFrame:
        """Blobs with what they refer to."""
        return self.case.stage(self._scan("blobs", key="id", value="data").select("file_id", "row", F.col("key").alias("blob"), "size", "value", "wal_applied", _shape("value").alias("shape")))

    def _order(self) -> DataFrame:
        """file_id, row, blob, position, state (oversized, tree or content), unreferenced. Of blobs of one name the last is referred to and the first can be the root."""
        wanted = self.head.select("file_id", F.lower(text.json_text(F.col("doc"), "latestRootBlobId")).alias("wanted"))
        name = Window.partitionBy("file_id", F.lower("blob"))
        r = self.rows.select("file_id", "row", "blob", F.col("value").isNull().alias("large"), "shape", F.max("row").over(name).alias("last"), F.min("row").over(name).alias("first")).join(wanted, "file_id")
        key = F.when(F.col("row") == F.col("last"), F.lower("blob")).otherwise(F.concat(F.lit("#"), F.col("row").cast("string")))
        root = F.coalesce((F.lower("blob") == F.col("wanted")) & (F.col("row") == F.col("first")), F.lit(False))
        r = self.case.stage(r.select("file_id", "row", "blob", key.alias("key"), root.alias("root"), F.col("shape.refs").alias("children"), F.when(F.col("large"), "oversized").when(F.col("shape.tree"), "tree").otherwise("content").alias("state")))
        o = trees.blob_order(r.select(F.col("file_id").cast("string").alias("store"), F.col("key").alias("id"), "row", "root", "children"))
        rooted = r.groupBy("file_id").agg(F.bool_or("root").alias("rooted"))
        placed = r.join(o.select(F.col("store").cast("long").alias("file_id"), F.col("id").alias("key"), "position", "reached"), ["file_id", "key"]).join(rooted, "file_id")
        return self.case.stage(placed.select("file_id", "row", "blob", "position", "state", (F.col("rooted") & ~F.col("reached")).alias("unreferenced"), "rooted"))

    def _sessions(self) -> DataFrame:
        folder = F.element_at(F.split("rel_path", "/"), -2)
        get = lambda k: text.json_text(F.col("doc"), k)
        created = times.lenient(F.get_json_object("doc", "$.createdAt"))
        model = get("lastUsedModel")
        s = self.whole.join(self.head, "file_id").select("file_id", "store_id", "rel_path", "mtime", F.lit(self.root_id).cast("long").alias("root_id"), folder.alias("folder"), get("agentId").alias("agent"), F.coalesce(get("agentId"), folder).alias("harness_session_id"), F.lit("primary").alias("kind"), get("name").alias("title"), created.alias("created"), F.when(model.isNotNull(), F.array(model)).otherwise(F.array().cast("array<string>")).alias("models"))
        both = F.col("created").isNotNull() & F.col("mtime").isNotNull()
        s = s.withColumns({"first_ts": F.when(both, F.col("created")), "first_ts_origin": F.when(both, "stored").otherwise("absent"), "last_ts": F.when(both, F.col("mtime")), "last_ts_origin": F.when(both, "file_mtime").otherwise("absent"), "bounds_from_adapter": both})
        return self.case.stage(numbered(s, ["rel_path"], last_id(self.case, "sessions")))

    def _said(self) -> DataFrame:
        """Blobs that are no nodes of the tree, in order: role, what they hold, whether they begin a turn, and the turn."""
        number = F.row_number().over(Window.partitionBy("file_id").orderBy("position")) - 1
        o = self.order.join(self.records.withColumn("record", number), ["file_id", "position"]).where("state = 'content'")
        rows = o.join(self.rows.select("file_id", "row", "size", "value"), ["file_id", "row"]).join(self.sessions.select("file_id", F.col("id").alias("session_id"), F.col("harness_session_id").alias("hsid")), "file_id")
        rows = rows.withColumn("doc", _utf8(F.col("value"))).withColumn("v", F.try_parse_json("doc"))
        message = F.coalesce(F.array_contains(F.json_object_keys("doc"), "role"), F.lit(False))
        rows = rows.withColumn("shape", F.when(F.col("v").isNull(), "derived").when(message, "message").otherwise("json"))
        given = _own(F.col("v"), "$.role")
        role = F.when((F.col("shape") == "message") & given.isin("user", "assistant", "system", "tool"), given).otherwise("meta")
        none = F.array().cast(BLOCKS)
        content = F.try_variant_get("v", "$.content", "variant")
        kind = F.coalesce(F.schema_of_variant(content), F.lit("VOID"))
        simple = lambda what, body, payload: F.array(F.struct(F.lit(what).alias("kind"), body.cast("string").alias("text"), payload.cast("string").alias("payload"), F.lit(None).cast("string").alias("tool_use_id")))
        many = F.try_variant_get("v", "$.content", "array<variant>")
        parts = F.when(kind == "STRING", simple("text", F.try_variant_get("v", "$.content", "string"), F.lit("null"))).when(kind.startswith("ARRAY"), F.transform(many, _block)).when(kind == "VOID", none).otherwise(F.array(_block(content)))
        found = _texts("value")
        rows = rows.withColumn("texts", F.when(F.col("shape") == "derived", found))
        other = F.when(F.col("shape") == "json", simple("other", F.lit(None), F.to_json("v"))).when(F.col("texts").isNull(), simple("other", F.lit(None), _json(bytes=F.col("size")))).otherwise(simple("text", F.col("texts"), F.lit("null")))
        rows = rows.withColumn("role", role).withColumn("parts", F.when(F.col("shape") == "message", parts.cast(BLOCKS)).otherwise(other.cast(BLOCKS)))
        begins = F.when(F.col("role") == "user", F.concat("hsid", F.lit(":"), F.col("record").cast("string")))
        w = Window.partitionBy("file_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
        turns = self.case.stage(rows.select("file_id", "session_id", "hsid", "position", "blob", "size", F.sha2("value", 256).alias("sha256"), "shape", "role", "parts", F.when(F.col("shape") == "message", F.col("doc")).alias("doc"), F.to_json(F.try_variant_get("v", "$.role", "variant")).alias("given"), "unreferenced", begins.alias("begins")))
        last = turns.select("file_id", "position", F.coalesce(F.last("begins", ignorenulls=True).over(w), F.concat("hsid", F.lit(":none"))).alias("turn"))
        return turns.join(last, ["file_id", "position"])

    def _provenance(self) -> DataFrame:
        """One for the header, each blob that is no node of the tree, and each node that the root does not reach."""
        h = self.head.where("doc is not null").select("file_id", F.lit(-1).cast("long").alias("position"), F.concat(F.lit("meta:"), "key").alias("locator"), F.col("size").alias("byte_length"), F.sha2("value", 256).alias("content_sha256"), F.lit("stored").alias("origin"))
        at = F.concat(F.lit("blobs:"), "blob").alias("locator")
        c = self.said.select("file_id", "position", at, F.col("size").alias("byte_length"), F.col("sha256").alias("content_sha256"), F.when(F.col("shape") == "derived", "derived").otherwise("stored").alias("origin"))
        t = self.order.where("state = 'tree' and unreferenced").join(self.rows.select("file_id", "row", "size", "value"), ["file_id", "row"]).select("file_id", "position", at, F.col("size").alias("byte_length"), F.sha2("value", 256).alias("content_sha256"), F.lit("stored").alias("origin"))
        logs = self.heads.select("file_id", "wal_applied").unionAll(self.rows.select("file_id", "wal_applied")).groupBy("file_id").agg(F.bool_or("wal_applied").alias("log"))
        rows = h.unionByName(c).unionByName(t).join(logs, "file_id").withColumn("locator", F.concat("locator", F.when(F.col("log"), " +wal").otherwise("")))
        return self.case.stage(numbered(rows, ["position"], last_id(self.case, "provenance")).withColumn("byte_offset", F.lit(0).cast("long")))

    def _messages(self) -> DataFrame:
        nodes = self.order.groupBy("file_id").agg(F.count_if(F.col("state") == "tree").alias("nodes"))
        s = self.sessions.select("file_id", F.col("id").alias("session_id"), "created")
        inner = lambda c: F.substring(c, 2, F.length(c) - 2)
        joined = lambda *parts: F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (F.length(x) > 0)), ","), F.lit("}"))
        turn = inner(_json(turn=F.col("turn")))
        h = self.head.where("doc is not null").join(nodes, "file_id", "left").join(s, "file_id")
        h = h.select("file_id", "session_id", F.lit(-1).cast("long").alias("position"), F.lit(0).alias("part"), F.lit("meta").alias("role"), F.lit("meta").alias("record_type"), F.col("key").alias("uuid"), F.col("created").alias("timestamp"), joined(inner(spans.without_udf("doc", F.lit("tree_nodes"))), inner(_json(tree_nodes=F.coalesce("nodes", F.lit(0))))).alias("attributes"), F.array().cast(BLOCKS).alias("parts"))
        split = (F.col("shape") == "message") & (F.col("role") != "tool")
        results = F.filter("parts", lambda b: b["kind"] == "tool_result")
        rest = F.filter("parts", lambda b: b["kind"] != "tool_result")
        kept = F.when(F.col("role") == "meta", inner(spans.without_udf("doc", F.lit("content")))).otherwise(inner(spans.without_udf("doc", F.lit("role content"))))
        own = F.when(F.col("shape") == "message", joined(kept, F.when(~F.col("role").isin("user", "meta"), turn))).when(F.col("shape") == "json", "{}").otherwise('{"confidence":"low","record_type":"protobuf"}')
        record = F.when(F.col("shape") == "message", "blob").when(F.col("shape") == "json", "json").otherwise("protobuf")
        c = self.said.select("file_id", "session_id", "position", F.lit(0).alias("part"), "role", record.alias("record_type"), F.col("blob").alias("uuid"), own.alias("attributes"), F.when(split, rest).when(F.col("role") == "tool", F.concat(rest, results)).otherwise(F.col("parts")).alias("parts"))
        t = self.said.where(split & (F.size(results) > 0)).select("file_id", "session_id", "position", F.lit(1).alias("part"), F.lit("tool").alias("role"), F.lit("blob.tool-result").alias("record_type"), F.col("blob").alias("uuid"), joined(turn).alias("attributes"), results.alias("parts"))
        p = self.provenance.select("file_id", "position", F.col("id").alias("pid"))
        rows = h.unionByName(c, allowMissingColumns=True).unionByName(t, allowMissingColumns=True).join(p, ["file_id", "position"])
        rows = numbered(rows.withColumn("timestamp_origin", F.when(F.col("timestamp").isNull(), "absent").otherwise("stored")), ["position", "part"], last_id(self.case, "messages"))
        return self.case.stage(rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy("session_id").orderBy("id")) - 1).cast("long")))

    def _blocks(self) -> DataFrame:
        b = self.messages.select("file_id", "session_id", "pid", F.col("id").alias("message_id"), "position", "part", F.posexplode("parts").alias("ordinal", "b")).select("file_id", "session_id", "pid", "message_id", F.col("ordinal").cast("long").alias("ordinal"), F.struct("position", "part", "ordinal").alias("place"), "b.*")
        return self.case.stage(numbered(b, ["place"], last_id(self.case, "blocks")))

    def _stream(self) -> DataFrame:
        b = self.blocks.where("kind in ('tool_use', 'tool_result') and tool_use_id is not null")
        return b.select(F.struct("file_id", "tool_use_id").alias("key"), F.col("place").alias("position"), F.when(F.col("kind") == "tool_use", "use").otherwise("result").alias("kind"))

    def _calls(self) -> DataFrame:
        """Calls in the order in which they are given out."""
        stream = self._stream()
        order = tools.emission_order(tools.pair(stream).withColumn("file", F.col("key.file_id")), stream).select(F.col("key.file_id").alias("file_id"), "use_position", "result_position", "number")
        use = self.blocks.select("file_id", "session_id", F.col("place").alias("use_position"), F.col("id").alias("use_block"), "payload")
        result = self.blocks.select("file_id", F.col("place").alias("result_position"), F.col("id").alias("result_block"), F.col("text").alias("result_text"))
        given = F.to_json(F.try_variant_get(F.try_parse_json("payload"), "$.input", "variant"))
        rows = order.join(use, ["file_id", "use_position"]).join(result, ["file_id", "result_position"], "left")
        rows = rows.withColumn("name", F.coalesce(text.json_text(F.col("payload"), "name"), F.lit(""))).withColumn("input", F.when(given != "null", given)).withColumn("is_error", F.lit(False)).withColumn("category", text.editor_category(F.col("name"))).drop("payload")
        return self.case.stage(numbered(rows, ["number"], last_id(self.case, "tool_calls")))

    def claims(self) -> DataFrame:
        c = self.sessions.select("file_id", F.col("id").alias("session_id"), F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("cursor:composerId").alias("scheme"), F.col("agent").alias("claimed_id")), F.struct(F.lit(1).alias("n"), F.lit("cursor:store-session").alias("scheme"), F.when(~F.col("agent").eqNullSafe(F.col("folder")) & (F.col("folder") != ""), F.col("folder")).alias("claimed_id")))).alias("c"))
        c = c.select("file_id", "session_id", "c.*").where("claimed_id is not null").withColumn("join_status", F.lit("unmatched"))
        return numbered(c, ["n"], last_id(self.case, "identity_claims"))

    def anomalies(self) -> DataFrame:
        """What is odd, in files, headers, blobs and fields."""
        s = self.sessions.select("file_id", F.col("id").alias("session_id"))
        as_ = lambda kind, severity: (F.lit(kind).alias("kind"), F.lit(severity).alias("given"))
        absent = F.array_except(F.array(*(F.lit(t) for t in TABLES)), "tables")
        strange = self.stores.where(F.size("tables") < len(TABLES)).select("file_id", *as_("unknown_store_generation", "info"), _json(missing=absent[0]).alias("details"))
        large = self.heads.where("reason = 'large'").select("file_id", *as_("oversized_record", "warning"), _json(key=F.col("key"), length=F.col("size")).alias("details"))
        bad = self.heads.where("reason <> 'large'").select("file_id", *as_("malformed_record", "error"), _json(key=F.col("key"), length=F.col("size"), reason=F.col("reason")).alias("details"))
        root = text.json_text(F.col("doc"), "latestRootBlobId")
        rootless = self.head.where(root.isNotNull()).join(self.order.where("rooted").select("file_id").distinct(), "file_id", "left_anti").join(s, "file_id").select("file_id", "session_id", *as_("missing_transcript", "info"), _json(latestRootBlobId=root).alias("details"))
        blob = _json(blob=F.col("blob")).alias("details")
        huge = self.order.where("state = 'oversized'").join(self.rows.select("file_id", "row", "size"), ["file_id", "row"]).join(s, "file_id").select("file_id", "session_id", *as_("oversized_record", "warning"), _json(blob=F.col("blob"), length=F.col("size")).alias("details"))
        p = self.provenance.select("file_id", "position", F.col("id").alias("pid"), "locator")
        lost = self.order.where("unreferenced").join(p, ["file_id", "position"]).join(s, "file_id").select("file_id", "session_id", "pid", *as_("unreferenced_record", "info"), blob)
        said = self.said.join(p, ["file_id", "position"])
        roles = said.where("shape = 'message' and role = 'meta'").select("file_id", "session_id", "pid", *as_("unknown_record_type", "info"), _json(role=F.try_parse_json("given")).alias("details"))
        plain = said.where("shape = 'json'").select("file_id", "session_id", "pid", *as_("unknown_record_type", "info"), blob)
        fields = said.where("shape = 'message'").select("file_id", "session_id", "pid", "locator", F.explode(F.json_object_keys("doc")).alias("field")).where(~F.col("field").isin(*MESSAGE_FIELDS)).groupBy("file_id", "session_id", "field").agg(F.count("*").alias("n"), F.min_by("locator", "pid").alias("first"), F.min("pid").alias("pid"))
        fields = fields.select("file_id", "session_id", "pid", *as_("unknown_field", "info"), _json(record_kind=F.lit("message"), field=F.col("field"), count=F.col("n"), first_locator=F.col("first")).alias("details"))
        at = self.blocks.select("file_id", "session_id", "pid", F.col("place").alias("result_position"))
        lone = tools.pair(self._stream()).where("status = 'unpaired'").select("key.file_id", "key.tool_use_id", "result_position").join(at, ["file_id", "result_position"]).select("file_id", "session_id", "pid", *as_("unpaired_tool_result", "warning"), _json(tool_call_id=F.col("tool_use_id")).alias("details"))
        log = self.heads.where("wal_applied").select("file_id").unionAll(self.rows.where("wal_applied").select("file_id")).distinct().select("file_id", *as_("wal_applied", "info"), F.lit("{}").alias("details"))
        out = strange
        for more in (large, bad, rootless, huge, lost, roles, plain, fields, lone, log):
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def kept(self) -> DataFrame:
        """The bytes of every header and blob that provenance names."""
        h = self.head.where("doc is not null").select(F.col("value").alias("content"))
        return h.unionAll(self.order.where("state = 'content' or state = 'tree' and unreferenced").join(self.rows.select("file_id", "row", "value"), ["file_id", "row"]).select("value"))
