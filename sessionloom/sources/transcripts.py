"""Agent transcripts: JSON records into messages, blocks, calls, observations and anomalies, each one plan."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import secrets, text, times
from ..operators import tools
from . import jsonl

CONVERSATION = ("user", "assistant", "system")
# Record types that carry no message.
META = "ai-title custom-title summary attachment last-prompt mode permission-mode atis-latch bridge-session file-history-snapshot file-history-delta queue-operation cost-state pr-link".split()
TITLES = {"ai-title": "aiTitle", "custom-title": "customTitle", "summary": "summary"}


def read(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """Records of the transcript files below root with the members that all later plans use."""
    return fields(jsonl.parsed(jsonl.records(jsonl.lines(spark, root, glob))))


def fields(r: DataFrame, *more: str) -> DataFrame:
    """The members of parsed records that all later plans use, and further columns of the records."""
    get = lambda p: F.get_json_object("text", p)
    kind = text.json_text(F.col("text"), "type")
    return r.select(
        *more, "path", "index", "offset", "length", "sha256", "terminated", "anomaly", "text", kind.alias("record_type"), F.coalesce(text.json_text(F.col("text"), "sessionId"), F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)).alias("session"),
        times.normalise(get("$.timestamp")).alias("timestamp"), get("$.uuid").alias("uuid"), get("$.parentUuid").alias("parent_uuid"), get("$.message.model").alias("model"), get("$.message.content").alias("content"),
        F.try_variant_get(F.try_parse_json("text"), "$.message.content", "variant").alias("v"), get("$.cwd").alias("cwd"), get("$.toolUseResult").alias("outcome"),
    )


def blocks(records: DataFrame) -> DataFrame:
    """Blocks of each message: a string is one text block, an array one block for each part."""
    listed = F.schema_of_variant("v").startswith("ARRAY")
    whole = F.schema_of_variant("v") != "VOID"
    parts = F.when(listed, F.try_variant_get("v", "$", "array<variant>")).when(whole, F.array("v"))
    written = F.when(listed, F.from_json("content", "array<string>")).when(whole, F.array("content"))  # as in the record: keys keep their order
    b = records.where(F.col("record_type").isin(*CONVERSATION)).select("path", "session", "index", "timestamp", "record_type", "outcome", written.alias("written"), F.posexplode(parts).alias("ordinal", "b"))
    get = lambda p, t="string": F.try_variant_get("b", p, t)
    kind = F.when(F.schema_of_variant("b") == "STRING", "text").when(get("$.type").isin("text", "thinking", "tool_use", "tool_result", "image"), get("$.type")).otherwise("other")
    body = F.when(F.schema_of_variant("b") == "STRING", get("$")).when(kind == "text", get("$.text")).when(kind == "thinking", get("$.thinking")).when(kind == "tool_result", text.flatten_text(F.to_json(get("$.content", "variant"))))
    payload = F.try_element_at("written", F.col("ordinal") + 1)
    payload = F.when(F.schema_of_variant("b") == "STRING", F.to_json("b")).otherwise(payload)
    attached = records.where("record_type = 'attachment'").select("path", "session", "index", "timestamp", F.lit(0).cast("long").alias("ordinal"), F.lit("attachment").alias("kind"), F.try_variant_get(F.try_parse_json("text"), "$.attachment.content", "string").alias("text"), F.lit(False).alias("is_error"), F.get_json_object("text", "$.attachment").alias("payload"))
    shown = b.select("path", "session", "index", "timestamp", F.col("ordinal").cast("long").alias("ordinal"), kind.alias("kind"), body.alias("text"), F.coalesce(F.when(kind == "tool_use", get("$.id")), F.when(kind == "tool_result", get("$.tool_use_id"))).alias("tool_use_id"), get("$.name").alias("name"), F.get_json_object(payload, "$.input").alias("input"), F.coalesce(get("$.is_error", "boolean"), F.lit(False)).alias("is_error"), payload.alias("payload"), "outcome")
    return shown.unionByName(attached, allowMissingColumns=True)


def messages(records: DataFrame, found: DataFrame) -> DataFrame:
    """One message for each sound record, numbered within its session."""
    only = found.groupBy("path", "index").agg(F.bool_and(F.col("kind") == "tool_result").alias("results_only"))
    role = F.when((F.col("record_type") == "user") & F.coalesce("results_only", F.lit(False)), "tool").when(F.col("record_type").isin(*CONVERSATION), F.col("record_type")).otherwise("meta")
    w = Window.partitionBy("session").orderBy("path", "index")
    sound = records.where("anomaly is null or anomaly = 'invalid_utf8'").join(only, ["path", "index"], "left")
    return sound.select("path", "index", "session", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), role.alias("role"), "record_type", "uuid", "parent_uuid", "timestamp", F.when(F.col("timestamp").isNull(), "absent").otherwise("stored").alias("timestamp_origin"), "model", "sha256", "offset", "length")


def tool_calls(found: DataFrame) -> DataFrame:
    """Calls from uses and results with the same id in one file."""
    b = found.where("kind in ('tool_use', 'tool_result') and tool_use_id is not null")
    position = F.struct("index", "ordinal")
    stream = b.select(F.struct("path", "tool_use_id").alias("key"), position.alias("position"), F.when(F.col("kind") == "tool_use", "use").otherwise("result").alias("kind"))
    use = b.where("kind = 'tool_use'").select("path", "session", "tool_use_id", position.alias("use_position"), "name", "input", "timestamp")
    result = b.where("kind = 'tool_result'").select("path", "tool_use_id", position.alias("result_position"), F.col("text").alias("result_text"), "is_error", "outcome")
    pairs = tools.pair(stream).select("key.path", "key.tool_use_id", "use_position", "result_position", "status")
    calls = pairs.where("status <> 'unpaired'").join(use, ["path", "tool_use_id", "use_position"]).join(result, ["path", "tool_use_id", "result_position"], "left")
    return calls.withColumn("category", text.category(F.col("name"))).withColumn("is_error", F.coalesce("is_error", F.lit(False)))


def observations(calls: DataFrame) -> DataFrame:
    """What calls did; a call with several edits gives one observation for each."""
    arg = lambda k: text.json_text(F.col("input"), k)
    n = F.col("name")
    kind = F.when(n == "Bash", "command_executed").when(n.isin("Read", "NotebookRead", "Glob", "Grep"), "file_read").when(n == "Write", "file_written").when(n.isin("Edit", "MultiEdit", "NotebookEdit"), "file_edited").when(n.isin("WebFetch", "WebSearch"), "url_referenced").when(n.isin("Agent", "Task"), "subagent_spawned")
    times_ = F.when(n == "MultiEdit", F.coalesce(F.size(F.try_variant_get(F.try_parse_json("input"), "$.edits", "array<variant>")), F.lit(0))).otherwise(1)
    path = F.when(n.isin("Glob", "Grep"), arg("path")).when(n == "WebFetch", arg("url")).when(n == "NotebookEdit", arg("notebook_path")).when(n.isin("Read", "NotebookRead"), F.coalesce(arg("file_path"), arg("notebook_path"))).when(n.isin("Write", "Edit", "MultiEdit"), arg("file_path"))
    rows = calls.withColumn("kind", kind).where("kind is not null").withColumn("times", times_).where("times > 0")
    return rows.select("path", "session", "tool_use_id", "use_position", "kind", path.alias("target"), F.when(n == "Bash", arg("command")).alias("command"), "timestamp", F.when(n.isin("Glob", "Grep"), "medium").otherwise("high").alias("confidence"), F.explode(F.sequence(F.lit(1), "times")).alias("edit"))


def secret_candidates(found: DataFrame) -> DataFrame:
    """Secrets in the texts of blocks and in the inputs of calls."""
    both = F.explode(F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("t")), F.struct(F.lit("input").alias("field"), F.col("input").alias("t"))))
    rows = found.select("path", "session", "index", "ordinal", both.alias("x")).where("x.t is not null")
    return secrets.scan(rows.withColumn("field", F.col("x.field")), F.col("x.t"), "path", "session", "index", "ordinal", "field").select("path", "session", "index", "ordinal", "field", "m.*")


def anomalies(records: DataFrame, found: DataFrame) -> DataFrame:
    """What is odd: damaged records, unknown types, conversation without a time, results without a use."""
    known = F.col("record_type").isin(*CONVERSATION, *META)
    bad = records.where("anomaly is not null").select("path", "index", F.col("anomaly").alias("kind"))
    odd = records.where(F.col("anomaly").isNull() & ~F.coalesce(known, F.lit(False))).select("path", "index", F.lit("unknown_record_type").alias("kind"))
    untimed = records.where(F.col("record_type").isin(*CONVERSATION) & F.col("timestamp").isNull() & F.col("anomaly").isNull()).select("path", "index", F.lit("missing_timestamp").alias("kind"))
    b = found.where("kind in ('tool_use', 'tool_result') and tool_use_id is not null")
    stream = b.select(F.struct("path", "tool_use_id").alias("key"), F.struct("index", "ordinal").alias("position"), F.when(F.col("kind") == "tool_use", "use").otherwise("result").alias("kind"))
    lone = tools.pair(stream).where("status = 'unpaired'").select("key.path", "result_position.index", F.lit("unpaired_tool_result").alias("kind"))
    return bad.unionByName(odd).unionByName(untimed).unionByName(lone)


def title_of() -> Column:
    """The title that a record gives its session, if any."""
    return F.coalesce(*(F.when(F.col("record_type") == k, text.json_text(F.col("text"), m)) for k, m in TITLES.items()))


def titles(records: DataFrame) -> DataFrame:
    """The last title of each session."""
    return records.withColumn("title", title_of()).where("title is not null").groupBy("session").agg(F.max_by("title", F.struct("path", "index")).alias("title"))
