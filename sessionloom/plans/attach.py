"""Takes a directory into a case after finding out which harness wrote it."""

import json
import os

from pyspark.sql import SparkSession

from ..sources import identify
from . import ingest, ingest_agent, ingest_editor

INGESTS = {"claude-code": ingest.ingest, "cursor": ingest_agent.ingest, "cursor-ide": ingest_editor.ingest}


def attach(case, path: str, label: str, harness: str | None = None) -> int:
    """Takes up a directory and gives the root's id. Without a harness the directory must bear signs of exactly one."""
    if harness is None:
        found = identify.identify(case.spark, path)
        if len(found) > 1:
            raise ValueError(f"{path} bears signs of {', '.join(found)}; name one")
        if not found:
            inner = "; ".join(f"{d} ({', '.join(x)})" for d, x in _inside(case.spark, path).items())
            raise ValueError(f"{path} bears no signs of a harness" + (f"; it contains {inner}" if inner else ""))
        harness = next(iter(found))
    return INGESTS[harness](case, path, label)


def _inside(spark: SparkSession, path: str) -> dict[str, dict[str, list[str]]]:
    """The directories one level down that bear signs, with what they bear."""
    out: dict[str, dict[str, list[str]]] = {}
    for r in identify.candidates(spark, path).collect():  # a row for each directory that bears signs, not for each that was looked at
        out.setdefault(os.path.join(path, r["inside"]), {})[r["harness"]] = r["signs"]
    return out


def inventory(spark: SparkSession, path: str) -> str:
    """What a directory bears signs of, itself and one level down, as JSON."""
    return json.dumps({"path": path, "harnesses": identify.identify(spark, path), "inside": _inside(spark, path)}, ensure_ascii=False)
