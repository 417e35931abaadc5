"""Checks a case against its evidence: files are hashed anew, blobs as well; what differs becomes an anomaly."""

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import integrity
from ..session import ordered_numbers
from ..sinks import contents
from ..sinks.case import Case
from ..sources import manifest


def files(case: Case) -> DataFrame:
    """root_id, id, rel_path, sha256, now, state of the newest version of each file whose root is there: ok, drift or missing. A link is checked by its target. A file that cannot be opened, or vanishes meanwhile, is missing."""
    newest = integrity.latest(case.table("source_files"), ["root_id", "rel_path", "encoded"])
    out = None
    for r in case.table("evidence_roots").select("id", "path").orderBy("id").collect():  # one row a root
        if r["path"] and os.path.isdir(r["path"]):
            now = manifest.manifest(case.spark, r["path"], links=True).select("rel_path", "encoded", F.col("sha256").alias("now"))
            one = newest.where(F.col("root_id") == r["id"]).select("root_id", "id", "rel_path", "encoded", "kind", "sha256").join(now, ["rel_path", "encoded"], "left")
            out = one if out is None else out.unionByName(one)
    if out is None:
        return case.spark.createDataFrame([], "root_id long, id long, rel_path string, sha256 string, now string, state string")
    known = out.where("kind <> 'symlink' or sha256 is not null")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("sha256"), "ok").otherwise("drift")
    return known.select("root_id", "id", "rel_path", "sha256", "now", state.alias("state"))


def blobs(case: Case) -> DataFrame:
    """sha256, state of blobs: ok, bad (missing or not what their name says) or unindexed."""
    held = contents.states(case.table("blob_contents"))
    both = case.table("blobs").select("sha256", F.lit(True).alias("listed")).distinct().join(held, "sha256", "full")
    return both.select("sha256", F.when(F.col("listed").isNull(), "unindexed").when(F.col("good"), "ok").otherwise("bad").alias("state"))


def verify(case: Case) -> dict:
    """Counts of what was checked, by state, and the roots that are not there; each drift, missing file and bad blob is written as an anomaly."""
    f, b = case.stage(files(case)), case.stage(blobs(case))
    gone = [r["path"] for r in case.table("evidence_roots").select("path").orderBy("id").collect() if not r["path"] or not os.path.isdir(r["path"])]
    first = (case.table("anomalies").agg(F.max("id")).first()[0] or 0) + 1
    drift = F.col("state") == "drift"
    said = F.concat("rel_path", F.when(drift, " no longer matches its manifest hash").otherwise(" is missing or unreadable in the evidence root"))
    odd = f.where("state <> 'ok'").select("root_id", F.col("id").alias("source_file_id"), F.when(drift, "error").otherwise("warning").alias("severity"), said.alias("message"), F.to_json(F.struct(F.col("sha256").alias("expected"), F.col("now").alias("actual"))).alias("details"))
    root = case.table("evidence_roots").agg(F.min("id").alias("root_id"))
    lost = b.where("state = 'bad'").crossJoin(F.broadcast(root)).select("root_id", F.lit(None).cast("long").alias("source_file_id"), F.lit("error").alias("severity"), F.concat(F.lit("retained blob "), "sha256", F.lit(" is missing or corrupted")).alias("message"), F.to_json(F.struct(F.col("sha256").alias("blob"))).alias("details"))
    both = odd.unionByName(lost).withColumn("kind", F.lit("hash_drift"))
    case.append("anomalies", ordered_numbers(both, "root_id", "message").withColumn("id", F.lit(first) + F.col("number")))
    count = lambda df: {r["state"]: r["count"] for r in df.groupBy("state").count().collect()}
    out = {"files": count(f), "blobs": count(b), "roots_unavailable": gone}
    case.audit("verify", json.loads(json.dumps(out)))
    return out
