"""Line-delimited records with their exact place in the file; no UDF.

Files are split at any byte: Spark's line reader lets each range find its own first line, so one large file is read by many
tasks. Ranges are counted first (lines, records, bytes); a prefix sum over the ranges of a file gives each its base, and places
within a range come from a window over that range alone. No row holds more than one line and no window more than one range.

Lines end at line feeds; a carriage return before one is not part of a record. Empty lines are no records but count in index. A byte order mark,
which the reader swallows, is given back to the first line. Bytes need not be UTF-8.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Longer records are flagged and their content left out.
CAP = 64 << 20
_MARK = b"\xef\xbb\xbf"


def binary_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Path, size, time and content of the files below root."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def relative(path: Column, root: str) -> Column:
    """A path, as Spark gives it, from below a root."""
    return F.substring(F.regexp_replace(path, "^file:/*", "/"), len(root.rstrip("/")) + 2, 1 << 30)


def lines(spark: SparkSession, root: str, glob: str = "*.jsonl*") -> DataFrame:
    """path, size, block (first byte of the range that a line was found in), place (in the order of the range) and content of each line below root, also of empty ones."""
    found = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    found = found.select(relative(path, root).alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("content"))
    zero = F.lit(0).cast("long")  # of a file that is nothing but a mark the reader gives no line; only files of its length are read
    alone = binary_files(spark, root, glob).where(F.col("length") == len(_MARK)).where(F.col("content") == F.lit(_MARK))
    return found.unionAll(alone.select(relative(F.col("path"), root), "length", zero, zero, F.lit(b"")))


def records(found: DataFrame, cap: int = CAP) -> DataFrame:
    """path, index, nth, offset, length, content, terminated, oversized, sha256 of each record of some lines; nth counts the records of a file."""
    bare = F.when(F.endswith("content", F.lit(b"\r")), F.substring(F.col("content"), 1, F.length("content") - 1)).otherwise(F.col("content"))
    wide, some = F.length("content") + 1, (F.length(bare) > 0).cast("long")
    blocks = found.groupBy("path", "block").agg(F.max("size").alias("size"), F.count("*").alias("lines"), F.sum(some).alias("records"), F.sum(wide).alias("bytes"), F.min_by(some, "place").alias("head"))
    before, whole = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    marked = F.sum("bytes").over(whole) < F.col("size") - 1  # the reader took a mark of three bytes away
    base = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    bare_mark = (marked & (F.first("head").over(Window.partitionBy("path").orderBy("block")) == 0)).cast("int")  # then the first line is a record after all
    blocks = blocks.select("path", "block", marked.alias("marked"), base("lines").alias("lines"), (base("records") + bare_mark).alias("records"), base("bytes").alias("bytes"))
    w = Window.partitionBy("path", "block").orderBy("place")
    own = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.select("*", (F.row_number().over(w) - 1).alias("l"), own(some).alias("r"), own(wide).alias("b")).join(blocks, ["path", "block"])
    placed = placed.withColumn("index", F.col("lines") + F.col("l")).withColumn("first", F.col("marked") & (F.col("index") == 0))
    body = F.when(F.col("first"), F.concat(F.lit(_MARK), "content")).otherwise(F.col("content"))
    lost = F.when(F.col("first") | ~F.col("marked"), 0).otherwise(len(_MARK))
    placed = placed.withColumn("offset", F.col("bytes") + F.col("b") + lost).withColumn("content", body)
    terminated = F.col("offset") + F.length("content") < F.col("size")
    kept = placed.withColumn("terminated", terminated).withColumn("content", bare).where(F.length("content") > 0)
    content = F.when(F.length("content") <= cap, F.col("content"))
    return kept.select("path", F.col("index").cast("long").alias("index"), F.when(F.col("first"), 0).otherwise(F.col("records") + F.col("r")).cast("long").alias("nth"), F.col("offset").cast("long").alias("offset"), F.length("content").cast("long").alias("length"), content.alias("content"), "terminated", (F.length("content") > cap).alias("oversized"), F.sha2(content, 256).alias("sha256"))


def parsed(found: DataFrame) -> DataFrame:
    """found with its text, whether it is UTF-8, and the anomaly that its content shows, if any."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    document = F.try_parse_json(text)
    anomaly = F.when(F.col("oversized"), "oversized_record").when(document.isNull() & ~F.col("terminated"), "truncated_line").when(document.isNull(), "malformed_record").when(~F.is_valid_utf8(F.col("content").cast("string")), "invalid_utf8")
    return found.withColumn("text", text).withColumn("anomaly", anomaly)
