"""Messages: nesting, text, turns and the cards that they are shown on."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nest_blocks(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """messages with their blocks as an ordered array."""
    parts = blocks.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "text"))).alias("blocks"))
    return messages.join(parts.withColumnRenamed("message_id", "id"), "id", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<struct<ordinal:bigint,kind:string,text:string>>")))


def shown(messages: DataFrame, meta: bool = False) -> DataFrame:
    return messages if meta else messages.where("role <> 'meta'")


def joined_text(blocks: DataFrame, by: str) -> DataFrame:
    """The texts of each group in order, line by line."""
    return blocks.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text"))


def assign_turns(messages: DataFrame, starts: str = "role = 'user'") -> DataFrame:
    """messages with the id of the last record that starts a turn; before any, the session's own key."""
    w = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(F.expr(starts), F.col("id")), ignorenulls=True).over(w)
    return messages.withColumn("turn", F.coalesce(begun.cast("string"), F.concat(F.col("session_id").cast("string"), F.lit(":none"))))


def islands(records: DataFrame, hidden: str = "hidden") -> DataFrame:
    """records with the number of their card: shown records of one turn that follow each other are one card; hidden ones carry the number of the card before them."""
    w = Window.partitionBy("stream").orderBy("position")
    visible = records.where(f"not {hidden}")
    merges = (F.col("role") == "assistant") & (F.lag("role").over(w) == "assistant") & (F.col("turn_key") != "") & (F.col("turn_key") == F.lag("turn_key").over(w))
    marked = visible.withColumn("new_card", F.when(F.coalesce(merges, F.lit(False)), 0).otherwise(1)).unionByName(records.where(hidden).withColumn("new_card", F.lit(0)))
    return marked.withColumn("card", F.sum("new_card").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_card")


def cards(numbered: DataFrame, hidden: str = "hidden") -> DataFrame:
    return numbered.where(f"not {hidden}").groupBy("stream", "card").agg(F.count("*").alias("records"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))


def dividers(numbered: DataFrame, hidden: str = "hidden") -> DataFrame:
    """One divider for each run of hidden records, placed before the next card."""
    return numbered.where(hidden).groupBy("stream", F.col("card").alias("after_card")).agg(F.count("*").alias("hidden_records"), F.min("position").alias("first_position"))


def absorbed(messages: DataFrame) -> DataFrame:
    """messages (content_class, blocks) with whether each is drawn inside the calls that it answers: a record of results alone, all of known calls."""
    whole = (F.size("blocks") > 0) & F.forall("blocks", lambda b: (b["kind"] == "tool_result") & b["tool_call_id"].isNotNull())
    return messages.withColumn("absorbed", F.coalesce((F.col("content_class") == "tool_result") & whole, F.lit(False)))


def absorbed_by_call(messages: DataFrame) -> DataFrame:
    """tool_call_id, message_ids: of each call the records drawn inside it, in order of id."""
    calls = F.explode(F.array_distinct(F.transform("blocks", lambda b: b["tool_call_id"])))
    rows = absorbed(messages).where("absorbed").select("id", calls.alias("tool_call_id"))
    return rows.groupBy("tool_call_id").agg(F.array_sort(F.collect_list("id")).alias("message_ids"))
