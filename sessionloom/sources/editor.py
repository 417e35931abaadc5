"""An editor's key-value store: composers and their bubbles, workspaces, local history."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import linking


def composers(kv: DataFrame) -> DataFrame:
    """Composers of a store (key, value): id, title, times, model and the ids of their bubbles in order."""
    v = kv.where(F.col("key").startswith("composerData:")).select(F.substring("key", 14, 1 << 20).alias("composer"), F.make_valid_utf8(F.col("value").cast("string")).alias("doc"))
    get = lambda p: F.get_json_object("doc", p)
    listed = F.try_variant_get(F.try_parse_json("doc"), "$.fullConversationHeadersOnly", "array<struct<bubbleId:string,type:int>>")
    return v.select("composer", text.json_text(F.col("doc"), "name").alias("title"), times.lenient(get("$.createdAt")).alias("created"), times.lenient(get("$.lastUpdatedAt")).alias("updated"), get("$.modelConfig.modelName").alias("model"), F.coalesce(listed, F.array().cast("array<struct<bubbleId:string,type:int>>")).alias("headers"))


def bubbles(kv: DataFrame) -> DataFrame:
    """Bubbles of a store: composer, bubble, role, text, time, model and the tool call that each holds."""
    parts = F.split(F.substring("key", 10, 1 << 20), ":", 2)
    v = kv.where(F.col("key").startswith("bubbleId:")).select(parts[0].alias("composer"), parts[1].alias("bubble"), F.make_valid_utf8(F.col("value").cast("string")).alias("doc"))
    get = lambda p: F.get_json_object("doc", p)
    role = F.when(get("$.type") == "1", "user").when(get("$.type") == "2", "assistant").otherwise("meta")
    return v.select("composer", "bubble", role.alias("role"), get("$.text").alias("text"), times.lenient(get("$.createdAt")).alias("timestamp"), get("$.modelInfo.modelName").alias("model"), get("$.toolFormerData.name").alias("tool"), get("$.toolFormerData.toolCallId").alias("call"), get("$.toolFormerData.rawArgs").alias("input"), get("$.toolFormerData.status").alias("status"), get("$.toolFormerData.result").alias("result"))


def conversation(kv: DataFrame) -> DataFrame:
    """group (composer), item (bubble), state, position: bubbles in the order of the composer's list, then those that it does not list."""
    listed = composers(kv).select(F.col("composer").alias("group"), F.posexplode("headers").alias("position", "h")).select("group", F.col("h.bubbleId").alias("item"), "position")
    known = composers(kv).select(F.col("composer").alias("group"))
    present = bubbles(kv).select(F.col("composer").alias("group"), F.col("bubble").alias("item")).join(known, "group", "left_semi")
    return linking.listed_and_present(listed, present)


def orphans(kv: DataFrame) -> DataFrame:
    """Composers that only bubbles name."""
    return linking.missing(bubbles(kv).select("composer").distinct(), composers(kv), ["composer"])


def missing_times(kv: DataFrame) -> DataFrame:
    """How many bubbles of each composer have no time, and the first of them."""
    return bubbles(kv).where("timestamp is null").groupBy("composer").agg(F.count("*").alias("n"), F.min("bubble").alias("first"))


def tool_observations(found: DataFrame) -> DataFrame:
    """What the calls in bubbles did: kind, path, command; sure only where the call is known to have completed."""
    kind = text.editor_category(F.col("tool"))
    arg = lambda *keys: text.first_text(F.col("input"), list(keys))
    deletes = text.base_name(F.col("tool")).isin("Delete", "delete_file")
    what = F.when(kind == "shell", "command_executed").when(kind == "file_read", "file_read").when(kind == "file_write", "file_written").when(deletes, "file_deleted").when(kind == "file_edit", "file_edited").when(kind == "web", "url_referenced").when(kind == "agent", "subagent_spawned")
    rows = found.where("tool is not null").withColumn("kind", what).where("kind is not null")
    path = F.when(F.col("kind").startswith("file_"), arg(*text.PATHS)).when(F.col("kind") == "url_referenced", arg("url", "query"))
    return rows.select("composer", "bubble", "kind", path.alias("path"), F.when(F.col("kind") == "command_executed", arg("command")).alias("command"), "timestamp", F.when(F.col("status") == "completed", "high").otherwise("medium").alias("confidence"))


def workspaces(documents: DataFrame) -> DataFrame:
    """workspace, project_path of workspace documents (workspace, doc)."""
    uri = F.coalesce(text.json_text(F.col("doc"), "folder"), text.json_text(F.col("doc"), "workspace"))
    return documents.select("workspace", text.file_uri_path(uri).alias("project_path"))


def history(documents: DataFrame) -> DataFrame:
    """resource, position, id, timestamp of the entries of local-history documents (doc); malformed entries are skipped."""
    entries = F.try_variant_get(F.try_parse_json("doc"), "$.entries", "array<variant>")
    rows = documents.select(text.file_uri_path(text.json_text(F.col("doc"), "resource")).alias("resource"), F.posexplode(entries).alias("position", "e"))
    get = lambda p, t: F.try_variant_get("e", p, t)
    return rows.where(get("$.id", "string").isNotNull()).select("resource", F.col("position").cast("long").alias("position"), get("$.id", "string").alias("id"), times.from_millis(get("$.timestamp", "bigint")).alias("timestamp"), get("$.source", "string").alias("source"))
