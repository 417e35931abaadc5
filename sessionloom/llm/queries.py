"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html, licences, lmscore, merkle, neardup, neighbours, pii, quality, runs, substrings, toxicity

VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    """Path of the vocabulary file of the package public_tokenizers; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licensed(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_licences, op4_lm_scoring, op5_neighbours, op6_html, op7_substrings, op8_neardup, op9_pii, op10_bpe, op11_merkle, op12_runs, op13_quality, pipeline)}


def _words(text: str) -> str:
    """Rows (doc_id, k, word) of the words of a text, and the number of words of each document."""
    return f"""d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents),
      e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d), n AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d)"""


def _following(n: int) -> str:
    return " || ' ' || ".join(["word", *(f"lead(word, {j}) OVER o" for j in range(1, n))])


#: Plain windows and sets; the operators find the same rows by anchors and by signatures.
SUBSTRINGS_SQL = f"""WITH {_words("text")},
  g AS (SELECT doc_id, k, {_following(13)} AS s FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
  m AS (SELECT s, min(doc_id) AS first FROM g WHERE s IS NOT NULL GROUP BY s),
  c AS (SELECT DISTINCT doc_id, k + j AS k FROM g JOIN m USING (s), (SELECT unnest(range(0, 13)) AS j) WHERE first < doc_id)
  SELECT n.doc_id, n.n AS n_words, count(c.k) AS n_removed, sha256(coalesce(string_agg(e.word, ' ' ORDER BY e.k) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
  FROM n LEFT JOIN e USING (doc_id) LEFT JOIN c ON c.doc_id = e.doc_id AND c.k = e.k GROUP BY n.doc_id, n.n"""

NEARDUP_SQL = f"""WITH RECURSIVE {_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
  g AS (SELECT doc_id, {_following(5)} AS s FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
  h AS (SELECT DISTINCT doc_id, s FROM g WHERE s IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
  z AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
  both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
  r(node, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, y FROM r JOIN both_ways ON x = r.seen)
  SELECT r.node AS doc_id, coalesce(max(z.n), 0) AS n_shingles, min(r.seen) AS component_id, r.node = min(r.seen) AS kept FROM r LEFT JOIN z ON z.doc_id = r.node GROUP BY r.node"""


def _crc32_sql(number: str) -> str:
    """The checksum of a number in decimal."""
    step = f"list_reduce(list_prepend(xor(s, b), [{', '.join(['0::UBIGINT'] * 8)}]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda s, b: {step}), 4294967295::UBIGINT)"


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """Common tables of a forest with leaves (tree, k, hash, number of leaves): its nodes by level, and for each node what stands to the left and right in its run."""
    made = [f"{name}0(tree, k, h, n) AS ({leaves})"]
    made += [f"{name}{i + 1}(tree, k, h, n) AS (SELECT tree, k // 3, sha256(string_agg(h, '' ORDER BY k)), (n + 2) // 3 FROM {name}{i} WHERE n > 1 GROUP BY tree, k // 3, n)" for i in range(levels)]
    side = lambda rows: f"coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, k // 3 ORDER BY k ROWS BETWEEN {rows}), '')"
    made.append(f"{name}_nodes AS ({' UNION ALL '.join(f'SELECT {i} AS level, * FROM {name}{i}' for i in range(levels + 1))})")
    made.append(f"{name}_steps AS (SELECT tree, level, k, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} || '|' || {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS step FROM {name}_nodes WHERE n > 1)")
    return ", ".join(made)


def _merkle_sql(levels: int = 14) -> str:
    """Whole trees, level by level; each row's version is folded along its path."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256(concat({', '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"
    above = lambda name, k: f"{name}.k = {k} // CAST(power(3, {name}.level) AS BIGINT)"
    tampered = leaf("replace(text, chr(10), '')")
    return f"""WITH d AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {_crc32_sql("doc_id")} % 2 = 0 THEN {tampered} ELSE {leaf("text")} END AS now FROM documents),
  p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n FROM d),
  {_tree_sql("a", "SELECT tree, k, leaf, n FROM p", levels)}, {_tree_sql("b", "SELECT 0, tree, h, count(*) OVER () FROM a_nodes WHERE n = 1", levels)},
  s AS (SELECT p.tree, p.k, 0 AS part, a.level, a.step FROM p JOIN a_steps a ON a.tree = p.tree AND {above("a", "p.k")} UNION ALL SELECT p.tree, p.k, 1, b.level, b.step FROM p JOIN b_steps b ON {above("b", "p.tree")}),
  w AS (SELECT tree, k, list(step ORDER BY part, level) AS steps FROM s GROUP BY tree, k),
  f AS (SELECT p.doc_id, p.leaf, a.h AS subroot, b.h AS root, sha256(array_to_string(list_transform(coalesce(steps, []), lambda x: replace(x, '|', '')), '')) AS proof_sha256,
    list_reduce(list_prepend(p.now, coalesce(steps, [])), lambda node, x: sha256(split_part(x, '|', 1) || node || split_part(x, '|', 2))) AS folded_root
    FROM p JOIN a_nodes a ON a.tree = p.tree AND a.n = 1 JOIN b_nodes b ON b.n = 1 LEFT JOIN w ON w.tree = p.tree AND w.k = p.k)
  SELECT *, folded_root = root AS verified FROM f"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; tests compare the others with brute force."""
    return {"op7_substrings": SUBSTRINGS_SQL, "op8_neardup": NEARDUP_SQL, "op11_merkle": _merkle_sql()}
