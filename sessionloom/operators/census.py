"""What is there that no parser knows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fields(records: DataFrame, known: list[str], document: str = "document") -> DataFrame:
    """record_kind, field, n, first: members of JSON records that are not known."""
    keys = F.filter(F.json_object_keys(document), lambda k: ~k.isin(*known)) if known else F.json_object_keys(document)
    return records.select("record_kind", "position", F.explode(keys).alias("field")).groupBy("record_kind", "field").agg(F.count("*").alias("n"), F.min("position").alias("first_position"))


def prefixes(keys: DataFrame, column: str = "key", mark: str = ":") -> DataFrame:
    """How many keys have each prefix before the mark; keys without it count under the empty one."""
    at = F.instr(F.col(column), mark)
    return keys.groupBy(F.when(at > 0, F.expr(f"substring({column}, 1, instr({column}, '{mark}') - 1)")).otherwise("").alias("prefix")).agg(F.count("*").alias("n"))
