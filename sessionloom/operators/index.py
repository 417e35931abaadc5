"""A kept full-text index that is added to, in segments.

A segment holds the tokens of the documents that one call of `add` brought, in folders by hash of the token, a row for each block of documents and folder, and a row for each of these documents with its length and a mark of
its text. Both come from one pass over the texts, so each new text is taken apart once. Documents whose mark is known are not taken apart again. Of a document in several segments the newest row counts, so a changed document
cancels its older tokens, and a row without length takes a document out. A segment counts once it stands in the log, which is written last; what a failed
call leaves behind is never read. More than MOST segments are merged, rows that were cancelled left out. A query reads the folders of its own tokens alone, in all segments.
"""

from __future__ import annotations

import uuid

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

#: Files of a folder by hash of the block, segments that may stand side by side. Folders are the buckets of the token table's pages.
SPLITS, MOST = 16, 8

_DOCS = "doc long, length long, mark long"
_PAGES = search.PAGE.format(doc="long")
_LOG = "number long, name string, documents long, cancels long, replaced array<string>"


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def segments(self) -> list[tuple[int, str, int]]:
        """Number, name and cancelled documents of the segments that count, oldest first; there are few."""
        try:
            log = self.spark.read.schema(_LOG).parquet(f"{self.path}/log").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        gone = {n for r in log for n in r["replaced"]}
        return sorted((r["number"], r["name"], r["cancels"]) for r in log if r["name"] not in gone)

    def _read(self, part: str, schema: str) -> DataFrame:
        """Rows of a part of all segments, with the number of the segment."""
        out = self.spark.range(0).selectExpr(*(f"CAST(NULL AS {kind}) AS {name}" for name, kind in (c.split() for c in f"{schema}, segment long".split(", ")))).where("false")  # known to be empty as it is planned
        for number, name, _ in self.segments():
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{part}").withColumn("segment", F.lit(number).cast("long")))
        return out

    def documents(self) -> DataFrame:
        """doc, length, mark, segment: the row of each document that counts; length is null where it was taken out."""
        rows = self._read("documents", _DOCS)
        if not any(cancels for _, _, cancels in self.segments()):
            return rows
        return rows.groupBy("doc").agg(F.max_by(F.struct("length", "mark", "segment"), "segment").alias("x")).select("doc", "x.*")

    def lengths(self) -> DataFrame:
        return self.documents().where("length is not null").select("doc", "length")

    def add(self, docs: DataFrame, key: str, fields: list[str], whole: bool = False) -> int:
        """Takes up documents that are new or changed and gives their number. whole: docs are all there are, so others are taken out."""
        text = F.array(*(F.col(f).cast("string") for f in fields))
        rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.to_json(text)).alias("mark"), *(F.col(f).cast("string").alias(f"field {i}") for i, f in enumerate(fields)))
        known = self.documents().select("doc", F.col("mark").alias("was"), (F.col("length").isNotNull()).alias("there"))
        found = rows.join(known, "doc", "left").where(~F.coalesce(F.col("there") & (F.col("was") == F.col("mark")), F.lit(False)))
        named = found.select("doc", "mark", F.col("was").isNotNull().alias("again"), *(F.col(f"field {i}").alias(f) for i, f in enumerate(fields)))
        name = f"segment-{uuid.uuid4().hex}"
        self._tokens(search.postings(named, "doc", fields, ("mark", "again")), name)
        blocks = self.spark.read.schema(f"{_PAGES}, mark array<long>, again array<boolean>").parquet(f"{self.path}/{name}/tokens").where(F.col("bucket") == search.WHOLE)
        kept = blocks.select(F.inline(F.arrays_zip("doc", "pos", "mark", "again"))).select("doc", F.col("pos").cast("long").alias("length"), "mark", "again")
        if whole:
            gone = known.where("there").join(rows.select("doc"), "doc", "left_anti").select("doc", F.lit(None).cast("long").alias("length"), F.lit(0).cast("long").alias("mark"), F.lit(True).alias("again"))
            kept = kept.unionByName(gone)
        kept.write.parquet(f"{self.path}/{name}/documents")
        some = self.spark.read.parquet(f"{self.path}/{name}/documents").agg(F.count("*").alias("n"), F.count("length").alias("new"), F.count_if("again").alias("cancels")).first()
        if not some["n"]:
            return 0
        self._log(name, some["n"], some["cancels"], [])
        if len(self.segments()) > MOST:
            self.merge()
        return some["new"]

    def _tokens(self, pages: DataFrame, name: str) -> None:
        """Writes a token table in folders by bucket. The pages of one are dealt to several files by block."""
        pages.repartition("bucket", F.pmod(F.xxhash64(F.get("doc", F.lit(0))), F.lit(SPLITS))).sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/tokens")

    def _log(self, name: str, n: int, cancels: int, replaced: list[str]) -> None:
        number = max((k for k, _, _ in self.segments()), default=0) + 1
        self.spark.createDataFrame([(number, name, n, cancels, replaced)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _places(self, wanted: list[str] | None) -> DataFrame:
        """doc, field, pos, token of the documents that count; of the tokens that are wanted, read from their folders alone."""
        rows = search.places(self._read("tokens", _PAGES), wanted, "bucket", "segment")
        if any(cancels for _, _, cancels in self.segments()):
            rows = rows.join(self.documents().where("length is not null").select("doc", "segment"), ["doc", "segment"], "left_semi")
        return rows.select("doc", "field", "pos", "token", "bucket")

    def phrase(self, query: str) -> DataFrame:
        """doc, field, n of the documents that hold the query as a phrase."""
        return search.adjacent(self._places(search.query_tokens(query)), query)

    def merge(self) -> None:
        """Puts all segments together into one; older ones are no longer read."""
        old, name = [n for _, n, _ in self.segments()], f"segment-{uuid.uuid4().hex}"
        places = self._places(None)
        dealt = places.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(SPLITS))).sortWithinPartitions("bucket", "field", "token", "doc", "pos")
        self._tokens(dealt.mapInArrow(_paged, _PAGES), name)
        live = self.documents().where("length is not null").select("doc", "length", "mark")
        live.write.parquet(f"{self.path}/{name}/documents")
        self._log(name, live.count(), 0, old)


def _paged(batches):
    """Pages of places that come in order of field and token."""
    for batch in batches:
        for field in batch.column("field").unique().to_pylist():
            some = batch.filter(pc.equal(batch.column("field"), field))
            yield search.pages(field, some.column("token"), some.column("doc"), some.column("pos").to_numpy(), {})
