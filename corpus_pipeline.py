"""A corpus pipeline: five stages, each of one operator, from raw documents to token counts.

Each stage takes (spark, docs, sf_dir) and gives what it keeps; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents; further columns, whatever their
names, are not passed on. Null texts are never dropped but for being copies of nothing; empty ones neither. Texts of any length are
treated whole. Rows without doc_id pass all stages. Repeated rows are judged each by its own text; the stage of near duplicates keeps one
of rows that share doc_id and text. Ties go to the smaller doc_id. Empty tables give empty ones, and an empty table of
labels or of the benchmark rejects nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bpe, decontaminate, neardup, pii, toxicity
from sessionloom.llm.common import checkpoint_dir, cut, groups_for, text_bytes
from sessionloom.llm.queries import table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Near duplicates have 0.8 or more of their shingles of five words in common; with so many bands a pair at 0.8 is missed with probability 9e-6.
SIMILARITY, BANDS = 80, 22


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; it is fitted on the labelled rows of the whole table of documents."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _columns(toxicity.score(docs, model, "toxicity").where(F.col("toxicity") < toxicity.THRESHOLD))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more): the one with the least doc_id. Rows without doc_id or words stay. Where ids repeat, each text counts by itself, and the first of an id's texts in their order is the least."""
    docs, key = _columns(docs), "doc_id"
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        # numbers in order of id and text in place of the ids; the sort is by ranges, so no task gets it all
        once = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
        docs, key = cut(once.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("row", F.monotonically_increasing_id())), "row"
    of = docs.where("doc_id is not null").select(F.col(key).alias("doc_id"), "text")
    away = neardup.near_duplicates(of, similarity=SIMILARITY, bands=BANDS).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    return _columns(docs.join(away, key, "left_anti")).coalesce(groups_for(text_bytes(docs), 32 << 20, 24))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return _columns(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With pseudonyms for personal numbers, dates and addresses, by the session's key; n_chars counts the new text."""
    done = pii.pseudonymise(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return _columns(done)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids; the ids decode to the text."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary()).select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_private),
    ("bpe", tokenise),
]

#: The stages are a fitted classifier, hashes and merges, which SQL does not express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; what lies between them is kept in the shared folder, below a name of its own, and may be removed once the result has been read."""
    docs = table(spark, sf_dir, "documents")
    between = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{between}/{k}-{name}")
            docs = spark.read.parquet(f"{between}/{k}-{name}")
    return docs
