"""Links between sessions, claims of identity, and what is referenced or listed but absent."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parents(sessions: DataFrame) -> DataFrame:
    """id, parent_id: the least session of the same root that bears the claimed parent's name, where no parent is set."""
    p = sessions.select("root_id", F.col("name").alias("parent_name"), F.col("id").alias("p"))
    return sessions.where("parent_id is null").join(p, ["root_id", "parent_name"]).where("p <> id").groupBy("id").agg(F.min("p").alias("parent_id"))


def resolve(claims: DataFrame, candidates: DataFrame) -> DataFrame:
    """Status of each claim (id, session, scheme, claimed) by the sessions that the claimed value leads to in candidates (claimed, candidate), itself left out: none, one or several.

    Of each value only the number of candidates, the least and the greatest are kept: where one is left, it is one of these two. So a value that
    many claim and many bear costs each of them one row. A claim whose value or session is null is kept; null candidates count for nothing."""
    known = candidates.where("claimed is not null and candidate is not null").select("claimed", "candidate").distinct()
    ends = known.groupBy("claimed").agg(F.count("*").alias("n"), F.min("candidate").alias("least"), F.max("candidate").alias("most"))
    own = known.select("claimed", F.col("candidate").alias("session"), F.lit(1).alias("own"))
    both = claims.join(ends, "claimed", "left").join(own, ["claimed", "session"], "left")
    n = F.coalesce(F.col("n"), F.lit(0)) - F.coalesce("own", F.lit(0))
    other = F.when(F.col("least") == F.col("session"), F.col("most")).otherwise(F.col("least"))
    return both.select("id", "session", "claimed", n.cast("long").alias("hits"), F.when(n == 0, "unmatched").when(n == 1, "matched").otherwise("ambiguous").alias("status"), F.when(n == 1, other).alias("match"))


def adopt(resolved: DataFrame) -> DataFrame:
    """session, parent_id: of matched claims the first in order of id."""
    return resolved.where("status = 'matched'").groupBy("session").agg(F.min_by("match", "id").alias("parent_id"))


def claim_candidates(claims: DataFrame, sessions: DataFrame) -> DataFrame:
    """claimed, candidate: sessions that make the same claim, and those that bear the claimed name."""
    return claims.select("claimed", F.col("session").alias("candidate")).union(sessions.select(F.col("name").alias("claimed"), F.col("id").alias("candidate"))).distinct()


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left without a partner."""
    return left.join(right.select(*on), on, "left_anti")


def listed_and_present(listed: DataFrame, present: DataFrame) -> DataFrame:
    """group, item, state, position: items in the order of their list, first mention only; then present ones that no list names."""
    first = listed.groupBy("group", "item").agg(F.min("position").alias("position"))
    both = first.withColumn("l", F.lit(1)).join(present.select("group", "item").distinct().withColumn("p", F.lit(1)), ["group", "item"], "full")
    state = F.when(F.col("l").isNull(), "unreferenced").when(F.col("p").isNull(), "missing").otherwise("present")
    w = Window.partitionBy("group").orderBy(F.col("l").isNull(), "position", "item")
    return both.select("group", "item", state.alias("state"), F.row_number().over(w).cast("long").alias("position"))
