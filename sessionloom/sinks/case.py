"""A case: a folder of Parquet tables, a log that only grows, annotations as events."""

import datetime
import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations
from ..schema import TABLES, schema
from . import contents

VERSION = 2


class Case:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        info = json.loads(spark.read.text(f"{path}/case.json", wholetext=True).first()[0])
        if info["schema_version"] > VERSION:
            raise ValueError("the case was written by a newer version")

    @classmethod
    def create(cls, spark: SparkSession, path: str, name: str) -> "Case":
        if os.path.exists(path) and os.listdir(path):
            raise ValueError("the folder is not empty")
        spark.createDataFrame([(json.dumps({"name": name, "schema_version": VERSION}),)], "value string").coalesce(1).write.text(f"{path}/case.json")
        case = cls(spark, path)
        case.audit("case_created", {"name": name})
        return case

    def table(self, name: str) -> DataFrame:
        """A table, merged over the columns of all versions; empty where nothing was written yet."""
        try:
            return self.spark.read.option("mergeSchema", "true").schema(schema(name)).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema(name))

    def append(self, name: str, rows: DataFrame) -> None:
        rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(name).fields)).write.mode("append").parquet(f"{self.path}/{name}")

    def audit(self, action: str, details: dict) -> None:
        at = datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        n = self.table("audit_log").count() + 1
        self.append("audit_log", self.spark.createDataFrame([(n, at, action, json.dumps(details))], TABLES["audit_log"]))

    def put_blobs(self, rows: DataFrame) -> None:
        """Adds contents (content binary) that are not there yet."""
        found = rows.select(F.sha2("content", 256).alias("sha256"), "content").join(self.table("blob_contents").select("sha256"), "sha256", "left_anti")
        staged = self.stage(contents.split(found.dropDuplicates(["sha256"])))
        self.append("blob_contents", staged)
        sizes = staged.groupBy("sha256").agg(F.sum(F.length("content")).cast("long").alias("size"))
        self.append("blobs", sizes.join(self.table("blobs").select("sha256"), "sha256", "left_anti"))

    def put_files(self, files: DataFrame, root: str, block: int = contents.BLOCK) -> None:
        """Adds the contents of files (rel_path, encoded) below a root that are not there yet, of any size; each file is read once. What cannot be read is left out."""
        blocks = self.stage(contents.read(files, root, block))
        whole = blocks.where("sha256 is not null").select("rel_path", "encoded", "sha256", "size").dropDuplicates(["sha256"])
        new = self.stage(whole.join(self.table("blob_contents").select("sha256"), "sha256", "left_anti"))
        self.append("blob_contents", blocks.drop("sha256", "size").join(new.drop("size"), ["rel_path", "encoded"]))
        self.append("blobs", new.select("sha256", "size").join(self.table("blobs").select("sha256"), "sha256", "left_anti"))

    def stage(self, rows: DataFrame) -> DataFrame:
        """rows as a written table, which cuts their lineage; it lies in the case's folder, which all executors see."""
        at = f"{self.path}/staging/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.parquet(at)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes a table anew from rows that may be derived from it."""
        wanted = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema(name).fields))
        self.stage(wanted).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def annotate(self, target_type: str, target_id: int, kind: str, value: str) -> int:
        """Adds an annotation to a row that exists and gives its id."""
        wanted = self.spark.createDataFrame([(target_type, target_id, kind, value)], "target_type string, target_id long, kind string, value string")
        if refused := annotations.checked(wanted, self).first()["refused"]:
            raise ValueError(refused)
        n = (self.table("annotations").agg(F.max("id")).first()[0] or 0) + 1
        self._annotation((n, target_type, target_id, kind, value, False), "annotation_created")
        return n

    def remove_annotation(self, n: int) -> None:
        row = self.annotations().where(F.col("id") == n).first()
        if row is None:
            raise KeyError(n)
        self._annotation((n, row["target_type"], row["target_id"], row["kind"], row["value"], True), "annotation_deleted")

    def _annotation(self, row: tuple, action: str) -> None:
        at = datetime.datetime.now(datetime.UTC).isoformat(timespec="microseconds").replace("+00:00", "Z")
        self.append("annotations", self.spark.createDataFrame([(*row[:5], at, row[5])], TABLES["annotations"]))
        self.audit(action, dict(zip(("id", "target_type", "target_id", "kind", "value", "at"), (*row[:5], at), strict=True)))

    def annotations(self, target_type: str | None = None, target_id: int | None = None) -> DataFrame:
        """The annotations that stand, of all targets, of a type or of one row, by id."""
        out = annotations.standing(self.table("annotations"))
        for column, value in (("target_type", target_type), ("target_id", target_id)):
            out = out if value is None else out.where(F.col(column) == value)
        return out.orderBy("id")

    def output(self, name: str, evidence: list[str], path: str) -> str:
        """Where an export may go: not inside evidence, not over something."""
        real = os.path.realpath(path)
        if any(real == os.path.realpath(e) or real.startswith(os.path.realpath(e) + os.sep) for e in evidence):
            raise ValueError("exports must not be written into evidence")
        if os.path.exists(real):
            raise ValueError("the file is there already")
        return real

    def exported(self, path: str, kind: str, rows: int) -> str:
        """Records an export with the hash of its file, of a folder that of its files in order of name."""
        h = hashlib.sha256()
        for name in [f"{path}/{n}" for n in sorted(os.listdir(path))] if os.path.isdir(path) else [path]:
            with open(name, "rb") as f:
                while part := f.read(1 << 16):
                    h.update(part)
        self.audit("export", {"path": path, "format": kind, "rows": rows, "sha256": h.hexdigest()})
        return h.hexdigest()

    def exports(self) -> DataFrame:
        return self.table("audit_log").where("action = 'export'").orderBy(F.desc("id"))
