"""What is told of a case: the counts of an ingest, and its evidence, sessions, inventory and verification as lines of text or as JSON."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sessions as s


def ingest(case, root_id: int | None = None) -> DataFrame:
    """One row: files by what became of them, rows of each table, and the parsers (name/version) that took part, of a root or of the whole case. Each count is one pass over a few columns."""
    mine = lambda df: df if root_id is None else df.where(F.col("root_id") == root_id)
    files, sessions = mine(case.table("source_files")), mine(case.table("sessions")).select(F.col("id").alias("session_id"))
    of = lambda name: case.table(name).join(sessions, "session_id", "left_semi")
    status = lambda *k: F.count_if(F.col("parse_status").isin(*k))
    counts = files.agg(status("parsed").alias("files_parsed"), status("inventoried").alias("files_inventoried"), status("failed").alias("files_failed"), status("superseded").alias("files_superseded"), F.count_if(F.col("version") > 1).alias("files_drifted"))
    parsers = case.table("provenance").join(files.select(F.col("id").alias("source_file_id")), "source_file_id", "left_semi").where("parser is not null")
    parsers = parsers.agg(F.array_join(F.array_sort(F.collect_set(F.concat("parser", F.lit("/"), F.coalesce("parser_version", F.lit("-"))))), ", ").alias("parsers"))
    rows = s.totals(sessions=sessions, messages=of("messages"), tool_calls=of("tool_calls"), observations=of("observations"), anomalies=mine(case.table("anomalies")))
    return counts.crossJoin(rows).crossJoin(parsers)  # rows of one


def _or(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("-"))


def evidence(case) -> DataFrame:
    """id, line of each root."""
    r = case.table("evidence_roots")
    return r.select("id", F.concat_ws("  ", F.col("id").cast("string"), "harness", "label", "path", F.lit("host=- user=- os=-")).alias("line"))


def sessions(rows: DataFrame) -> DataFrame:
    """id, line of sessions with their harness, children and anomalies, as `api.sessions` gives them."""
    at = F.concat(_or("first_ts"), F.lit(".."), _or("last_ts"))
    n = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit(0)).cast("string"))
    numbers = F.concat_ws(" ", n("msgs", "message_count"), n("tools", "tool_call_count"), n("anomalies", "anomalies"), n("children", "children"))
    return rows.select("id", F.concat_ws("  ", F.col("id").cast("string"), "harness", "kind", "harness_session_id", at, numbers, F.coalesce("title", F.lit(""))).alias("line"))


def files(rows: DataFrame) -> DataFrame:
    """id, line of source files."""
    version = F.when(F.col("version") > 1, F.concat(F.lit(" v"), F.col("version").cast("string"))).otherwise("")
    error = F.when(F.col("error").isNotNull(), F.concat(F.lit(" ("), "error", F.lit(")"))).otherwise("")
    link = F.when(F.col("kind") == "symlink", " symlink (not followed)").otherwise("")
    return rows.select("id", F.concat(F.lit("  file "), F.col("id").cast("string"), F.lit(" "), "rel_path", version, link, F.lit(" "), _or("size"), F.lit(" bytes sha256="), F.coalesce(F.left("sha256", F.lit(12)), F.lit("-")), F.lit(" "), _or("parse_status"), error).alias("line"))


def anomalies(rows: DataFrame) -> DataFrame:
    """id, line of anomalies."""
    return rows.select("id", F.concat(F.lit("  ["), _or("severity"), F.lit("] "), _or("kind"), F.lit(" "), F.coalesce("message", F.lit(""))).alias("line"))


def inventory(case) -> DataFrame:
    """part, root, id, line of everything a case holds, to be read in the order of the first three: roots with their stores, absent stores and files, then anomalies, then the number of audit entries."""
    lit = lambda v: F.lit(v).cast("long")
    r = case.table("evidence_roots").select(lit(0).alias("part"), F.col("id").alias("root"), lit(0).alias("id"), F.concat(F.lit("root "), F.col("id").cast("string"), F.lit(" "), _or("harness"), F.lit(" "), _or("label"), F.lit(" ("), _or("path"), F.lit(")")).alias("line"))
    counts = case.table("source_files").select(F.col("store_id").alias("id"))
    st = s.with_counts(case.table("stores"), counts, "id", "files")
    st = st.select(lit(1).alias("part"), F.col("root_id").alias("root"), "id", F.concat(F.lit("  store "), F.col("id").cast("string"), F.lit(" "), _or("kind"), F.lit(" "), _or("rel_path"), F.lit(" ["), _or("status"), F.lit("] files="), F.col("files").cast("string")).alias("line"))
    gone = case.table("absent_stores").groupBy("root_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds")).select(lit(2).alias("part"), F.col("root_id").alias("root"), lit(0).alias("id"), F.concat(F.lit("  absent stores: "), "kinds").alias("line"))
    f = case.table("source_files")
    f = f.select("id", F.col("root_id").alias("root")).join(files(f), "id").select(lit(3).alias("part"), "root", "id", "line")
    listed = r.unionByName(st).unionByName(gone).unionByName(f)
    listed = listed.withColumn("part", F.col("root") * 4 + F.col("part"))  # a root's own lines stay together
    a = case.table("anomalies")
    last = F.lit(2**62).cast("long")
    head = a.agg(F.count("*").alias("n")).select(last.alias("part"), lit(0).alias("root"), lit(0).alias("id"), F.concat(F.lit("anomalies ("), F.col("n").cast("string"), F.lit("):")).alias("line"))
    log = case.table("audit_log").agg(F.count("*").alias("n")).select((last + 2).alias("part"), lit(0).alias("root"), lit(0).alias("id"), F.concat(F.lit("audit log ("), F.col("n").cast("string"), F.lit(" entries)")).alias("line"))
    return listed.unionByName(head).unionByName(anomalies(a).select((last + 1).alias("part"), lit(0).alias("root"), "id", "line")).unionByName(log)


def verified(states: dict) -> str:
    """The result of a verification as text."""
    f, b = states["files"], states["blobs"]
    lines = ["verify done", f"  files_checked: {sum(f.values())}", f"  drifted: {f.get('drift', 0)}", f"  missing: {f.get('missing', 0)}", f"  roots_unavailable: {len(states['roots_unavailable'])}", f"  blobs_checked: {b.get('ok', 0) + b.get('bad', 0)}", f"  blob_errors: {b.get('bad', 0)}"]
    return "\n".join(lines)
