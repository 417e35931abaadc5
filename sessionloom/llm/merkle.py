"""Operator 11: a Merkle manifest of a table, its root, a proof for each row and a check of each row's tampered version.

A leaf is the digest H (lowercase hex sha256) of a row's columns in order, each `-` if null, else byte count, `:` and value. The
leaves of a source stand in order of doc_id; every three neighbours have their digest as parent until one node is left, the source's
subroot. The subroots, in order of source, have a root in the same way. Where the checksum of doc_id is even, the row is tampered with:
the line feeds of its text are deleted.

The tree is persistent. Nodes are never changed: a tampered leaf makes a version that shares all nodes but the leaf's ancestors,
which it copies. A tree is cut into aligned blocks of BLOCK leaves, LEVELS levels high, each built in one group that also makes its
versions; the roots of the blocks are the leaves of the next tree, and so on, until there is one block. Versions go on above
their block by the path of that block, found once for all its leaves, so no version is ever a tree of its own
and no group grows with the input or with a source. Places within a source come from a sort by ranges and counts for each range, so a
source that holds most rows is dealt over many tasks.

Rows of equal doc_id and source stand in order of their leaves; a null doc_id comes first and is never tampered with; rows that are equal
in all columns are leaves each. A null source is a tree of its own, the first. Texts are hashed whole by Spark. A null or empty text has no line feeds, so it verifies.
An empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare

#: Children of a node; levels of a block, and its leaves.
ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS

_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_BLOCK_OF = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.string()), ("version", pa.string()), ("root", pa.string()), ("path", _PATH)])
_BLOCK_DDL = "tree string, at long, n long, doc_id long, hash string, version string, root string, path array<struct<left: string, right: string>>"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Tree:
    """The nodes over some leaves, level by level, up to `height` levels or to a single node."""

    def __init__(self, leaves: list[str], height: int | None = None):
        self.levels = [leaves]
        while len(self.levels[-1]) > 1 if height is None else len(self.levels) <= height:
            below = self.levels[-1]
            self.levels.append([_digest("".join(below[k : k + ARITY])) for k in range(0, len(below), ARITY)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, at: int) -> list[dict[str, str]]:
        """What stands to the left and to the right of a leaf's ancestors in their runs, from the leaf upwards."""
        out = []
        for level in self.levels[:-1]:
            first = at - at % ARITY
            out.append({"left": "".join(level[first:at]), "right": "".join(level[at + 1 : first + ARITY])})
            at //= ARITY
        return out

    def with_leaf(self, at: int, leaf: str) -> Version:
        return Version(self, at, leaf)


class Version:
    """A tree with one leaf replaced: it holds copies of that leaf's ancestors and shares all other nodes with the tree."""

    def __init__(self, tree: Tree, at: int, leaf: str):
        self.tree, self.at, self.copied = tree, at, [leaf]
        for x in tree.path(at):
            self.copied.append(_digest(x["left"] + self.copied[-1] + x["right"]))

    @property
    def root(self) -> str:
        return self.copied[-1]

    def node(self, level: int, at: int) -> str:
        return self.copied[level] if at == self.at // ARITY**level else self.tree.levels[level][at]


def _blocks(nodes: DataFrame) -> DataFrame:
    """nodes (tree, at, n, doc_id, hash, changed) with the root of their block, their path up to it and, where changed is not null, the root of the version with that hash. n is the number of nodes of the tree; a tree of one block ends in one node, others have full height."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at, changed = table["at"].to_pylist(), table["changed"].to_pylist()
        tree = Tree(table["hash"].to_pylist(), None if table["n"][0].as_py() <= BLOCK else LEVELS)
        own = [k % BLOCK for k in at]
        columns = {k: table[k] for k in ("tree", "at", "n", "doc_id", "hash")}
        columns["version"] = pa.array([tree.root if x is None else tree.with_leaf(k, x).root for k, x in zip(own, changed, strict=True)], pa.string())
        columns |= {"root": pa.array([tree.root] * len(at), pa.string()), "path": pa.array([tree.path(k) for k in own], _PATH)}
        return pa.table(columns).cast(_BLOCK_OF)

    return cut(nodes.withColumn("block", _block()).groupBy("tree", "block").applyInArrow(build, _BLOCK_DDL))


def _block() -> Column:
    return F.floor(F.col("at") / BLOCK).cast("long")


def _above(blocks: DataFrame) -> DataFrame:
    """(tree, block, above, root): of each block, the path from its root to the root of its tree, and that root."""
    roots = blocks.where(F.col("at") % BLOCK == 0).select("tree", _block().alias("at"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.lit(None).cast("long").alias("doc_id"), F.col("root").alias("hash"), F.lit(None).cast("string").alias("changed"))
    most = roots.agg(F.max("n")).first()[0]
    if most is None or most == 1:
        return roots.select("tree", F.col("at").alias("block"), F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("above"), F.col("hash").alias("root"))
    return paths(roots).select("tree", F.col("at").alias("block"), F.col("path").alias("above"), "root")


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, at, path, root) of nodes (tree, at, n, doc_id, hash, changed): the whole path to the root of the tree."""
    blocks = _blocks(nodes)
    return blocks.drop("root").withColumn("block", _block()).join(_above(blocks), ["tree", "block"]).select("tree", "at", F.concat("path", "above").alias("path"), "root")


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with `at`, their place among the rows of their tree, and `n`, how many those are. The sort is by ranges, no tree goes to one task."""
    by = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    rows = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by)).withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33))
    heads = rows.groupBy(tree, "part").agg(F.min("row").alias("first"), F.count("*").alias("size"))  # as many rows as ranges and trees
    before = f"coalesce(sum(size) OVER (PARTITION BY {tree} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    heads = heads.select(tree, "part", F.expr(f"first - {before}").alias("start"), F.expr(f"sum(size) OVER (PARTITION BY {tree})").alias("n"))
    return rows.join(heads, [tree, "part"]).withColumn("at", F.col("row") - F.col("start")).drop("row", "part", "start")


def leaf(text: Column) -> Column:
    """The digest of the columns doc_id, source, lang, n_chars and a text."""
    part = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.sha2(F.concat(*map(part, (F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), text))), 256)


def tampered() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs (doc_id, source, lang, n_chars, text)."""
    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), "source"), F.lit("")).alias("tree"),  # so that null comes first and apart from the empty name
        F.col("doc_id").cast("long").alias("doc_id"), leaf(text).alias("hash"), F.when(tampered(), leaf(F.translate(text, "\n", ""))).alias("changed"),
    )
    blocks = _blocks(placed(cut(leaves), "tree", "doc_id", "hash"))
    above = cut(_above(blocks))
    trees = placed(above.where("block = 0").select(F.lit("").alias("all"), "tree", F.col("root").alias("hash")), "all", "tree")
    top = paths(trees.select(F.col("all").alias("tree"), "at", "n", F.lit(None).cast("long").alias("doc_id"), "hash", F.lit(None).cast("string").alias("changed")))
    top = trees.drop("hash").join(top.select("at", "path", F.col("root").alias("top")), "at").select("tree", "path", "top")
    above = above.join(top, "tree").select("tree", "block", F.concat("above", "path").alias("above"), F.col("root").alias("subroot"), F.col("top").alias("root"))
    every = blocks.drop("root").withColumn("block", _block()).join(above, ["tree", "block"])
    siblings = F.array_join(F.transform(F.concat("path", "above"), lambda x: F.concat(x["left"], x["right"])), "")
    folded = F.aggregate("above", F.col("version"), lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))
    return every.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
