"""The query surface: one function for each question that can be asked of a case. `case` is anything with table(name) -> DataFrame of the canonical tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sinks import contents
from . import activity, annotations, messages as m, search as full_text, sessions as s
from .index import Index

# Bytes of a record shown at once, of a located record, and of a content that are looked at to tell whether it is binary.
WINDOW, RECORD, SNIFFED = 64 << 10, 64 << 20, 8192


def case_info(case) -> DataFrame:
    return case.table("case_info").crossJoin(s.totals(**{f"n_{n}": case.table(n) for n in ("evidence_roots", "source_files", "sessions", "tool_calls", "observations", "anomalies")}, n_messages=case.table("messages").where("role <> 'meta'")))


def roots(case) -> DataFrame:
    """Roots with their files, and how many of them are parsed."""
    f = case.table("source_files").groupBy("root_id").agg(F.count("*").alias("files"), F.count_if(F.col("parse_status") == "parsed").alias("parsed"), F.coalesce(F.sum(F.when(F.col("parse_status") == "parsed", F.col("record_count"))), F.lit(0)).cast("long").alias("records"))
    out = case.table("evidence_roots").join(f.withColumnRenamed("root_id", "id"), "id", "left")
    return out.fillna(0, ["files", "parsed", "records"]).orderBy("id")


def stores(case, root_id: int) -> DataFrame:
    files = case.table("source_files").select(F.col("store_id").alias("id"))
    return s.with_counts(case.table("stores").where(F.col("root_id") == root_id), files, "id", "files").orderBy("id")


def absent_stores(case, root_id: int) -> DataFrame:
    return case.table("absent_stores").where(F.col("root_id") == root_id).orderBy("kind")


def files(case, root_id: int) -> DataFrame:
    return case.table("source_files").where(F.col("root_id") == root_id).orderBy("rel_path", "version")


def anomalies(case, root_id: int | None = None, kind: str | None = None, severity: str | None = None, session_id: int | None = None) -> DataFrame:
    return activity.filtered(case.table("anomalies"), root_id=root_id, kind=kind, severity=severity, session_id=session_id).orderBy("id")


def audit(case) -> DataFrame:
    return case.table("audit_log").orderBy("id")


def sessions(case, root_id: int | None = None, harness: str | None = None, kind: str | None = None, project: str | None = None, since: str | None = None, until: str | None = None, has_children: bool = False, has_anomalies: bool = False) -> DataFrame:
    """Sessions, newest first, with their children and anomalies counted."""
    of = case.table("evidence_roots").select(F.col("id").alias("root_id"), "harness")
    out = activity.filtered(case.table("sessions").join(of, "root_id"), root_id=root_id, harness=harness, kind=kind)
    out = s.containing(out, "project_path", project) if project else out
    out = s.overlapping(out, since, until)
    children = case.table("sessions").where("parent_session_id is not null").select(F.col("parent_session_id").alias("id"))
    odd = case.table("anomalies").where("session_id is not null").select(F.col("session_id").alias("id"))
    out = s.with_counts(s.with_counts(out, children, "id", "children"), odd, "id", "anomalies")
    out = out.where("children > 0") if has_children else out
    return (out.where("anomalies > 0") if has_anomalies else out).orderBy(F.desc("first_ts"), F.desc("id"))


def session(case, session_id: int) -> DataFrame:
    return case.table("sessions").where(F.col("id") == session_id)


def children(case, session_id: int) -> DataFrame:
    return case.table("sessions").where(F.col("parent_session_id") == session_id).orderBy("first_ts", "id")


def _blocks(case, of: DataFrame) -> DataFrame:
    b = case.table("blocks").join(of.select(F.col("id").alias("message_id")), "message_id", "left_semi")
    parts = b.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", "kind", "text", "payload", "tool_use_id", "tool_call_id"))).alias("blocks"))
    return of.join(parts.withColumnRenamed("message_id", "id"), "id", "left")


def _classed(found: DataFrame) -> DataFrame:
    body = F.array_join(F.transform(F.filter("blocks", lambda b: b["kind"] == "text"), lambda b: b["text"]), "\n")
    kind = text.content_class(F.col("role"), body, F.col("attributes"))
    out = found.withColumn("content_class", kind).withColumn("turn_key", text.turn_key(F.col("role"), F.col("attributes")))
    label = F.when(F.col("content_class").isin("caveat", "injected"), text.injected_label(F.col("content_class"), body, F.col("attributes")))
    return m.absorbed(out.withColumn("injected_label", label))


def absorbed_results(case, session_id: int) -> DataFrame:
    """tool_call_id, message_ids: of each call of a session the records of results that are drawn inside it."""
    return m.absorbed_by_call(messages(case, session_id))


def messages(case, session_id: int, meta: bool = False) -> DataFrame:
    return _classed(_blocks(case, m.shown(case.table("messages").where(F.col("session_id") == session_id), meta))).orderBy("ordinal")


def message(case, message_id: int) -> DataFrame:
    return _classed(_blocks(case, case.table("messages").where(F.col("id") == message_id)))


def tool_calls(case, session_id: int) -> DataFrame:
    return case.table("tool_calls").where(F.col("session_id") == session_id).orderBy("id")


def tool_calls_of_message(case, message_id: int) -> DataFrame:
    """Calls whose use or result stands in the message: a union of two semi joins."""
    b = case.table("blocks").where(F.col("message_id") == message_id).select("id")
    calls = case.table("tool_calls")
    return calls.join(b.withColumnRenamed("id", "tool_use_block_id"), "tool_use_block_id", "left_semi").select(*calls.columns).union(calls.join(b.withColumnRenamed("id", "tool_result_block_id"), "tool_result_block_id", "left_semi").select(*calls.columns)).dropDuplicates(["id"]).orderBy("id")


def observations(case, session_id: int | None = None, kinds: list[str] | None = None) -> DataFrame:
    o = activity.filtered(case.table("observations"), session_id=session_id)
    return (o.where(F.col("kind").isin(*kinds)) if kinds else o).orderBy("timestamp", "id")


def activity_page(case, page: str, revealed: bool = True) -> DataFrame:
    """commands, files or indicators, each with its message and its session's title. revealed: with secrets as they are, else covered."""
    o = activity.of_kinds(case.table("observations"), page).withColumnsRenamed({"derived_from_block_id": "from_block", "derived_from_tool_call_id": "from_call", "derived_from_provenance_id": "from_record"})
    calls = case.table("tool_calls").select("id", F.col("tool_use_block_id").alias("use_block"))
    records = case.table("messages").select("id", F.col("provenance_id").alias("record"))
    titles = case.table("sessions").select(F.col("id").alias("session_id"), "title")
    if page == "indicators" and not revealed:
        o = o.withColumn("details", activity.masked(F.col("kind"), F.col("details")))
    return activity.with_message(o, case.table("blocks"), calls, records).join(titles, "session_id", "left").orderBy("timestamp", "id")


def provenance(case, provenance_id: int) -> DataFrame:
    f = case.table("source_files").select(F.col("id").alias("source_file_id"), "root_id", "rel_path", "encoded", F.col("sha256").alias("file_sha256"))
    r = case.table("evidence_roots").select(F.col("id").alias("root_id"), "label", F.col("path").alias("root_path"))
    return case.table("provenance").where(F.col("id") == provenance_id).join(f, "source_file_id").join(r, "root_id")


def window(content: Column, offset: Column, length: Column) -> Column:
    """total_length, offset, bytes_b64 of a window of some bytes, clamped to them and to WINDOW."""
    total = F.length(content).cast("long")
    start = F.least(offset.cast("long"), total)
    piece = F.substring(content, (start + 1).cast("int"), F.least(length.cast("long"), F.lit(WINDOW)).cast("int"))
    return F.struct(total.alias("total_length"), start.alias("offset"), F.replace(F.base64(piece), F.lit("\r\n"), F.lit("")).alias("bytes_b64"))


def raw(case, provenance_id: int, offset: int = 0, length: int = WINDOW) -> DataFrame:
    """total_length, offset, bytes_b64, verified of a record's bytes: one row, none where there is no such record. The whole record is read and checked first; what does not have its hash is an error.

    A record with a locator is its kept content; others are read from the kept copy of their file where there is one, else from the evidence."""
    record = provenance(case, provenance_id).first()
    spark = case.spark
    if record is None:
        return spark.createDataFrame([], "total_length long, offset long, bytes_b64 string, verified boolean")
    held = case.table("blob_contents")
    if record["locator"] is not None:
        bytes_ = contents.between(held, record["content_sha256"], 0, RECORD)
    else:
        bytes_ = contents.between(held, record["file_sha256"], record["byte_offset"], record["byte_length"])
        if bytes_.isEmpty():
            file = spark.createDataFrame([(record["rel_path"], record["encoded"])], "rel_path string, encoded boolean")
            bytes_ = contents.slice_of(file, record["root_path"], record["byte_offset"], record["byte_length"])
    found = bytes_.select("bytes", (F.sha2("bytes", 256) == record["content_sha256"]).alias("verified"))
    if not any(r["verified"] for r in found.select("verified").collect()):
        raise ValueError(f"the bytes of record {provenance_id} do not match its hash")
    return found.select(window(F.col("bytes"), F.lit(offset), F.lit(length)).alias("w"), "verified").select("w.*", "verified")


def blob(case, sha256: str, cap: int = 4 << 20) -> DataFrame:
    """sha256, size, binary, truncated, and the first bytes of a kept content, as text or, where they are binary, as base64. No row where it is not kept."""
    if len(sha256) != 64 or set(sha256) - set("0123456789abcdef"):
        raise ValueError("no hash")
    size = case.table("blobs").where(F.col("sha256") == sha256).groupBy("sha256").agg(F.max("size").alias("size"))
    return previewed(contents.between(case.table("blob_contents"), sha256, 0, cap).join(size, "sha256"))


def previewed(first: DataFrame) -> DataFrame:
    """Contents by their first bytes and size (sha256, bytes, size), as they are shown: binary are those with a NUL near the beginning, or that are no UTF-8 but for a letter cut off at the end."""
    nul = F.coalesce(F.position(F.lit(b"\0"), F.substring(F.col("bytes"), 1, SNIFFED)) > 0, F.lit(False))
    less = lambda k: F.substring(F.col("bytes"), 1, F.length("bytes") - k)
    end = lambda k: F.hex(F.substring(F.col("bytes"), F.length("bytes") - k + 1, F.lit(k)))
    cut = F.when(F.is_valid_utf8(F.col("bytes").cast("string")), 0)
    for k, lead in ((1, "^(C[2-9A-F]|D.|E.|F[0-4])$"), (2, "^(E.|F[0-4])[89AB].$"), (3, "^F[0-4]([89AB].){2}$")):
        cut = cut.when((F.length("bytes") >= k) & end(k).rlike(lead) & F.is_valid_utf8(less(k).cast("string")), k)
    rows = first.withColumn("binary", nul | cut.isNull()).withColumn("cut", F.coalesce(cut, F.lit(0)))
    shown = F.substring(F.col("bytes"), 1, F.length("bytes") - F.col("cut")).cast("string")
    return rows.select("sha256", "size", "binary", (F.length("bytes") < F.col("size")).alias("truncated"), F.when(~F.col("binary"), shown).alias("text"), F.when(F.col("binary"), F.replace(F.base64("bytes"), F.lit("\r\n"), F.lit(""))).alias("bytes_b64"))


def annotations_of_message(case, message_id: int) -> DataFrame:
    """Annotations on a message, on its blocks, and on calls whose use or result is in it, by id."""
    notes = annotations.of_messages(annotations.standing(case.table("annotations")), case.table("blocks"), case.table("tool_calls"))
    return notes.where(F.col("message_id") == message_id).drop("message_id").dropDuplicates(["id"]).orderBy("id")


def anomaly_kinds(case) -> DataFrame:
    """The kinds of anomalies that occur, in order."""
    return case.table("anomalies").select("kind").distinct().orderBy("kind")


# The two indexes of a case: the table, its fields, and the name under which hits are given.
INDEXES = {"block": ("blocks", ["text"]), "tool_call": ("tool_calls", ["name", "input", "result_text"])}


def keep_index(case) -> None:
    """Brings both indexes beside the case's tables up to date; only rows that are new or changed are taken apart. search(kept=True) reads them as they are."""
    for kind, (table, fields) in INDEXES.items():
        Index(case.spark, f"{case.path}/index/{kind}").add(case.table(table), "id", fields, whole=True)


def search(case, query: str, limit: int = 200, kept: bool = False) -> DataFrame:
    """The best hits of a phrase in blocks and in tool calls, in one list by their ranks in two indexes, with message, title and a snippet.

    A phrase stands within one field. A hit of a call points at the block that uses the tool. Equal ranks are given by kind and id."""
    spark = case.spark
    if not full_text.query_tokens(query):
        return full_text.top(spark.createDataFrame([], "kind string, doc long, block_id long, message_id long, session_id long, tool_call_id long, snippet string, title string, ordinal long, score double"), limit)
    best = {}
    for kind, (table, fields) in INDEXES.items():
        rows, index = case.table(table), Index(spark, f"{getattr(case, 'path', '')}/index/{kind}")
        found = index.phrase(query) if kept else full_text.phrases(rows, "id", fields, query)
        size = index.lengths() if kept else full_text.lengths(rows, "id", fields)
        shown = F.coalesce(*(full_text.snippet(F.col(f), query) for f in fields)).alias("snippet")
        best[kind] = full_text.ranked(found, size).join(rows.select(F.col("id").alias("doc"), *(c for c in ("message_id", "tool_use_block_id") if c in rows.columns), *fields), "doc").withColumn("snippet", shown)
    blocks = best["block"].select(F.lit("block").alias("kind"), "doc", F.col("doc").alias("block_id"), "message_id", F.lit(None).cast("long").alias("tool_call_id"), "snippet", "score")
    use = case.table("blocks").select(F.col("id").alias("tool_use_block_id"), "message_id")
    calls = best["tool_call"].join(use, "tool_use_block_id").select(F.lit("tool_call").alias("kind"), "doc", F.col("tool_use_block_id").alias("block_id"), "message_id", F.col("doc").alias("tool_call_id"), "snippet", "score")
    at = case.table("messages").select(F.col("id").alias("message_id"), "session_id", "ordinal")
    t = case.table("sessions").select(F.col("id").alias("session_id"), "title")
    hits = blocks.unionAll(calls).join(at, "message_id").join(t, "session_id")
    return hits.select("kind", "doc", "block_id", "message_id", "session_id", "tool_call_id", "snippet", "title", "ordinal", "score").orderBy(F.desc("score"), "kind", "doc").limit(max(1, min(limit, 1000)))


def grouped_hits(hits: DataFrame) -> DataFrame:
    """Hits by session: session_id, title, hits, and the best score, the best session first."""
    return hits.groupBy("session_id", "title").agg(F.count("*").alias("hits"), F.max("score").alias("score")).orderBy(F.desc("score"), "session_id")
