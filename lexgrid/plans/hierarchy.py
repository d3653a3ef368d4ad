"""Queries of problem 5: the tree of the chunks against their node paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..sources.tables import once, table


def own_mark(path):
    """The last bracketed group of a path, or all of it if it has none."""
    last = F.regexp_extract(path, r"(?s)^.*(\([^()]*\))", 1)
    return F.when(last != "", last).otherwise(path)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "chunks"), ["chunk_id", "corpus_version"], "parent_id", "node_path")


def _tree(chunks: DataFrame, full: bool = True) -> DataFrame:
    return H.hierarchy(chunks.select(F.col("corpus_version").alias("scope"), F.col("chunk_id").alias("id"), F.col("parent_id").alias("parent"), own_mark(F.col("node_path")).alias("mark"), F.col("node_path").alias("carry")), full)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks on or below a loop, without a root, or whose place in the tree is not that of their node path."""
    tree = _tree(_chunks(spark, d), False)
    issue = F.when(F.col("status").isin("cycle", "below_cycle", "no_root"), F.col("status")).when(~F.col("expected"), "moved")
    return tree.select(F.col("id").alias("chunk_id"), issue.alias("issue")).filter("issue is not null")


def p5_tree(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's full path, depth, root and number of descendants."""
    tree = _tree(_chunks(spark, d))
    tree = H.materialize(tree)
    below = H.descendants(tree).groupBy("scope", F.col("ancestor").alias("id")).agg(F.count("*").alias("descendants"))
    return tree.join(below, ["scope", "id"], "left").select(
        F.col("scope").alias("corpus_version"), F.col("id").alias("chunk_id"), "status", F.col("root").alias("root_id"), "depth", "path", F.coalesce("descendants", F.lit(0)).alias("descendants"), "back_edge"
    )


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a chunk and a chunk below it, with their distance."""
    return H.descendants(_tree(_chunks(spark, d))).select(F.col("scope").alias("corpus_version"), F.col("ancestor").alias("chunk_id"), F.col("descendant").alias("descendant_id"), F.col("distance").cast("int"))


_SQL = r"""
WITH RECURSIVE n AS (
  SELECT corpus_version AS v, chunk_id AS id, min(CASE WHEN trim(parent_id) <> '' THEN parent_id END) AS p, coalesce(min(node_path), '') AS np FROM chunks GROUP BY 1, 2
), m AS (
  SELECT v, id, p, np, CASE WHEN regexp_matches(np, '\([^()]*\)') THEN regexp_extract(np, '(?s)^.*(\([^()]*\))', 1) ELSE np END AS mark FROM n
), t AS (
  SELECT v, id, id AS root, mark AS path, 1 AS depth, np, [id] AS line FROM m WHERE p IS NULL
  UNION ALL SELECT m.v, m.id, t.root, t.path || m.mark, t.depth + 1, m.np, list_append(t.line, m.id) FROM t JOIN m ON m.v = t.v AND m.p = t.id
), lost AS (
  SELECT v, id FROM m WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m q WHERE q.v = m.v AND q.id = m.p)
  UNION ALL SELECT m.v, m.id FROM lost t JOIN m ON m.v = t.v AND m.p = t.id
), rest AS (
  SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.v = m.v AND t.id = m.id) AND NOT EXISTS (SELECT 1 FROM lost t WHERE t.v = m.v AND t.id = m.id)
), up AS (
  SELECT v, id AS start, p AS at FROM rest UNION SELECT up.v, up.start, rest.p FROM up JOIN rest ON rest.v = up.v AND rest.id = up.at
), looped AS (
  SELECT r.v, r.id, CASE WHEN EXISTS (SELECT 1 FROM up WHERE up.v = r.v AND up.start = r.id AND up.at = r.id) THEN 'cycle' ELSE 'below_cycle' END AS issue FROM rest r
)
"""

QUERIES = {"p5_found": p5_found, "p5_tree": p5_tree, "p5_descendants": p5_descendants}
SQL = {
    "p5_tree": _SQL + """, d AS (SELECT v, line[k] AS id, count(*) AS n FROM (SELECT *, unnest(generate_series(1, depth - 1)) AS k FROM t WHERE depth > 1) GROUP BY ALL), every AS (
        SELECT v, id, CASE WHEN depth = 1 THEN 'root' ELSE 'tree' END AS status, root, depth, path, false AS back_edge FROM t
        UNION ALL SELECT v, id, 'no_root', NULL, NULL, NULL, false FROM lost
        UNION ALL SELECT v, id, issue, NULL, NULL, NULL, issue = 'cycle' AND id = (SELECT min(up.at) FROM up WHERE up.v = looped.v AND up.start = looped.id) FROM looped)
        SELECT v AS corpus_version, id AS chunk_id, status, root AS root_id, depth, path, coalesce(n, 0) AS descendants, back_edge FROM every LEFT JOIN d USING (v, id)""",
    "p5_found": _SQL + "SELECT id AS chunk_id, issue FROM looped UNION ALL SELECT id, 'no_root' FROM lost UNION ALL SELECT id, 'moved' FROM t WHERE path <> np",
    "p5_descendants": _SQL + "SELECT v AS corpus_version, line[k] AS chunk_id, id AS descendant_id, CAST(depth - k AS INT) AS distance FROM t, generate_series(1, depth - 1) g(k)",
}
