"""Forests of sessions and trees of directories, with a guard against cycles.

Chains of parents are followed by pointer doubling: each round joins the table once with itself and doubles the
part of every chain that is known, so a chain of n hops takes log2(n) rounds. Nothing recurses.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

HOPS = 64


def _linked(sessions: DataFrame, *columns: Column | str) -> DataFrame:
    """id, above (the parent, if it is listed itself) and columns of sessions (id, parent_id)."""
    listed = sessions.select(F.col("id").alias("parent_id"), F.col("id").alias("above")).distinct()
    return sessions.join(listed, "parent_id", "left").select("id", "above", *columns)


def ancestors(spark: SparkSession, sessions: DataFrame, most: int = HOPS) -> DataFrame:
    """id, ancestor, distance: the listed sessions above each one, up to `most` hops, no session twice and none above itself."""
    tree = cut(_linked(sessions.select("id", "parent_id")).select("id", F.when(F.col("above").isNull(), F.array().cast("array<bigint>")).otherwise(F.array(F.col("above").cast("bigint"))).alias("chain")))
    known = 1
    while known < most:
        upper = tree.select(F.col("id").alias("last"), F.col("chain").alias("upper")).where(F.size("upper") > 0)
        last = F.when(F.size("chain") == known, F.element_at("chain", -1))  # a shorter chain has ended
        tree = cut(tree.withColumn("last", last).join(upper, "last", "left").select("id", F.when(F.col("upper").isNull(), F.col("chain")).otherwise(F.concat("chain", "upper")).alias("chain")))
        known *= 2
        if tree.where(F.size("chain") == known).isEmpty():
            break
    # what follows a session that comes again has been met before: chains that run into a cycle are cut there
    own = F.array_remove(F.array_distinct(F.slice("chain", 1, most)), F.col("id"))
    return tree.select("id", F.posexplode(own).alias("distance", "ancestor")).select("id", "ancestor", (F.col("distance") + 1).cast("long").alias("distance"))


def _cycle_starts(chained: DataFrame) -> DataFrame:
    """id of the sessions (id, above, position) on or below a cycle that stand before all that is above them: there the list breaks the cycle."""
    least = cut(chained.join(chained.select(F.col("id").alias("above"), F.col("position").alias("least")), "above").select("id", "position", F.col("above").alias("jump"), "least"))
    while True:
        upper = least.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("least").alias("upper"))
        least = cut(least.join(upper, "jump").select("id", "position", F.col("next").alias("jump"), F.least("least", "upper").alias("least"), (F.col("upper") < F.col("least")).alias("new")))
        if least.where("new").isEmpty():
            return least.where("position <= least").select("id")


def nested(spark: SparkSession, sessions: DataFrame, position: Column | None = None) -> DataFrame:
    """id, depth, path: sessions (id, parent_id) below their parents, to any depth; in order of path they stand depth first.

    position, a number of at least 0 that no two rows share (their id unless given), is the order of the list; path holds the
    positions from the root on, each padded to 19 digits. A session whose parent is not listed is a root. A cycle is
    broken where the list meets it first: before a session that comes earlier in the list than all above it."""
    tree = cut(_linked(sessions.select("id", "parent_id", (F.col("id") if position is None else position).cast("long").alias("position")), "position", F.array("position").alias("path")))
    tree = _grown(tree)
    cyclic = tree.where("above IS NOT NULL")
    if not cyclic.isEmpty():
        broken = cut(_linked(sessions.join(cyclic.select("id"), "id", "left_semi").select("id", "parent_id")).join(cyclic.select("id", "position"), "id"))
        starts = _cycle_starts(broken).withColumn("start", F.lit(True))
        broken = broken.join(starts, "id", "left").select("id", F.when(F.col("start").isNull(), F.col("above")).alias("above"), "position", F.array("position").alias("path"))
        tree = tree.where("above IS NULL").unionByName(_grown(cut(broken)))
    return tree.select("id", (F.size("path") - 1).cast("long").alias("depth"), F.array_join(F.transform("path", lambda p: F.lpad(p.cast("string"), 19, "0")), "/").alias("path"))


def _grown(tree: DataFrame) -> DataFrame:
    """tree (id, above, position, path) with paths up to their roots. above is the next session that a path does not hold yet; it stays set only where a chain never ends.

    Depths have no gaps, so a round that ends no path leaves only what hangs on a cycle."""
    left = tree.where("above IS NOT NULL").count()
    while left:
        upper = tree.select(F.col("id").alias("above"), F.col("above").alias("next"), F.col("path").alias("upper"))
        tree = cut(tree.join(upper, "above", "left").select("id", F.col("next").alias("above"), "position", F.when(F.col("upper").isNull(), F.col("path")).otherwise(F.concat("upper", "path")).alias("path")))
        before, left = left, tree.where("above IS NOT NULL").count()
        if left == before:
            break
    return tree


def directories(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Every directory above a file, with the number and bytes of the files below it."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.where(F.size(parts) > 1).select(F.explode(above).alias("directory"), "size").groupBy("directory").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes")).withColumn("depth", F.size(F.split("directory", "/")).cast("long"))


def blob_order(blobs: DataFrame) -> DataFrame:
    """store, id, position, reached: blobs of each store depth first from its root, children in order, each once; then the others in order of row. blobs has store, id, row, root (is it the root), children (array)."""
    import pandas as pd

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        children = dict(zip(pdf["id"], pdf["children"], strict=True))
        seen: dict[str, None] = {}
        stack = list(pdf.loc[pdf["root"], "id"][::-1])
        while stack:
            x = stack.pop()
            if x in seen or x not in children:
                continue
            seen[x] = None
            stack += list(children[x] if children[x] is not None else [])[::-1]
        order = [*seen, *(x for x in pdf["id"] if x not in seen)]
        return pd.DataFrame({"store": pdf["store"].iloc[0], "id": order, "position": range(len(order)), "reached": [x in seen for x in order]})

    return blobs.groupBy("store").applyInPandas(walk, "store string, id string, position long, reached boolean")
