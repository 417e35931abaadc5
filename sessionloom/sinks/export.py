"""Exports of a case: its timeline, checked, hashed and recorded. See `timeline` for how one ordered file is written by many tasks."""

import datetime
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import timeline
from . import timeline as sink
from .case import Case

# The formats and the endings of their files.
FORMATS = {"jsonl": ".jsonl", "csv": ".csv", "parquet": ".parquet"}


def default_output(case: Case, format: str, root_id: int | None = None, session_id: int | None = None) -> str:
    """A new name in the case's folder of exports, from the time and the scope."""
    scope = f"session-{session_id}" if session_id is not None else f"root-{root_id}" if root_id is not None else "case"
    stem = f"{case.path}/exports/{datetime.datetime.now(datetime.UTC):%Y%m%dT%H%M%SZ}-{scope}"
    n = 1
    while os.path.exists(path := stem + (f"-{n}" if n > 1 else "") + FORMATS[format]):
        n += 1
    return path


def run(case: Case, format: str, path: str | None = None, root_id: int | None = None, session_id: int | None = None) -> dict:
    """Writes the events of a case, a root or a session. Refuses unknown scopes and formats, places inside evidence, files that are there, and an empty timeline."""
    if format not in FORMATS:
        raise ValueError(f"no format {format}")
    events = case.stage(timeline.of_case(case, root_id, session_id))
    n = events.count()
    if not n:
        raise ValueError("nothing to export in this scope")
    path = path or default_output(case, format, root_id, session_id)
    os.makedirs(f"{case.path}/exports", exist_ok=True)
    path = case.output(path, [r["path"] for r in case.table("evidence_roots").select("path").where("path is not null").collect()], path)
    if format == "parquet":
        sink.write_parquet(events, path, now=datetime.datetime.now(datetime.UTC).isoformat())
    else:
        (sink.write_json_lines if format == "jsonl" else sink.write_csv)(events, path)
    return {"path": path, "format": format, "rows": n, "sha256": case.exported(path, format, n)}


def listed(case: Case) -> DataFrame:
    """name, format, rows, sha256, at, there of the exports in the case's folder, newest first."""
    d = F.try_parse_json("details")
    get = lambda k, t: F.try_variant_get(d, f"$.{k}", t)
    folder = os.path.realpath(f"{case.path}/exports")
    there = os.listdir(folder) if os.path.isdir(folder) else []
    out = case.exports().select("id", get("path", "string").alias("path"), get("format", "string").alias("format"), get("rows", "bigint").alias("rows"), get("sha256", "string").alias("sha256"), "at")
    name = F.element_at(F.split("path", "/"), -1)
    return out.where(F.col("path") == F.concat(F.lit(folder + "/"), name)).select(name.alias("name"), "format", "rows", "sha256", "at", name.isin(*there).alias("there"), "id").orderBy(F.desc("id")).drop("id")


def file_of(case: Case, name: str) -> str:
    """The path of an export by its name alone."""
    path = f"{case.path}/exports/{name}"
    if name in ("", ".", "..") or "/" in name or "\\" in name or os.path.islink(path) or not os.path.isfile(path):
        raise KeyError(name)
    return path


def report(case: Case) -> str:
    """What a case holds, as JSON text: its counts, roots, sessions by kind, anomalies by severity, and exports."""
    from ..operators import api

    out = {"case": api.case_info(case).first(), "roots": api.roots(case).collect(), "sessions": case.table("sessions").groupBy("kind").count().orderBy("kind").collect(), "anomalies": case.table("anomalies").groupBy("kind", "severity").count().orderBy("kind", "severity").collect()}
    return json.dumps({k: [r.asDict() for r in v] if isinstance(v, list) else v.asDict() if v else None for k, v in out.items()}, indent=1)
