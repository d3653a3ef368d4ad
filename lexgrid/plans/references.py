"""Queries of problem 1: references of the corpus tables that no chunk answers to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import references as R
from ..session import materialize
from ..sources.tables import once, table

BY_PATH, BY_ID = "path", "id"


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """All references in one form: (ref_table, ref_field, ref_key, scope, key, at); the scope holds the version and the kind of key."""
    cross = once(table(spark, d, "cross_references"), ["ref_id"], "corpus_version", "target_path", "from_path", "extracted_at")
    field = lambda name: F.struct(F.lit(name).alias("ref_field"), F.col(name).alias("path"))
    by_path = (
        cross.select("ref_id", "corpus_version", "extracted_at", F.explode(F.array(field("target_path"), field("from_path"))).alias("r"))
        .filter(~R.blank(F.col("r.path")))
        .select(
            F.lit("cross_references").alias("ref_table"), F.col("r.ref_field").alias("ref_field"), F.col("ref_id").cast("string").alias("ref_key"),
            F.struct(F.lit(BY_PATH).alias("by"), "corpus_version").alias("scope"), R.same_citation(F.col("r.path")).alias("key"), F.col("extracted_at").alias("at"),
        )
    )
    vectors = once(table(spark, d, "chunk_embeddings"), ["chunk_id"], "corpus_version", "created_at").filter(~R.blank(F.col("chunk_id")))
    by_id = vectors.select(
        F.lit("chunk_embeddings").alias("ref_table"), F.lit("chunk_id").alias("ref_field"), F.col("chunk_id").alias("ref_key"),
        F.struct(F.lit(BY_ID).alias("by"), "corpus_version").alias("scope"), F.col("chunk_id").alias("key"), F.col("created_at").alias("at"),
    )
    return by_path.unionByName(by_id)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Chunks under both kinds of key. A repeat has a later ingested_at, so the earliest row of a chunk stands for it."""
    chunks = once(table(spark, d, "chunks"), ["chunk_id", "corpus_version", "node_path"], "ingested_at", "removed_at")
    key = lambda by, value: F.struct(F.lit(by).alias("by"), value.alias("value"))
    return chunks.select(
        "corpus_version", "ingested_at", "removed_at",
        F.explode(F.array(key(BY_PATH, R.same_citation(F.col("node_path"))), key(BY_ID, F.col("chunk_id")))).alias("k"),
    ).filter(F.col("k.value").isNotNull()).select(
        F.struct(F.col("k.by").alias("by"), "corpus_version").alias("scope"), F.col("k.value").alias("key"), F.col("ingested_at").alias("seen_at"), "removed_at"
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference that no usable chunk answers to."""
    refs = _refs(spark, d)
    state = R.fold(R.reference_deltas(refs), R.record_deltas(_records(spark, d)))
    return R.orphans(refs, state).select("ref_table", "ref_field", "ref_key", "reason", "period")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans counted per table, field, period and reason."""
    return R.report(p1_found(spark, d))


def p1_maintained(spark: SparkSession, d: str) -> DataFrame:
    """The report from a state that is maintained: all before April 2023 is folded first, later references, chunks and removals come as a second batch of deltas."""
    refs, records = materialize(_refs(spark, d)), materialize(_records(spark, d))
    cut = F.lit("2023-04-01").cast("timestamp")
    early = lambda c: F.coalesce(F.col(c) < cut, F.lit(True))
    gone = records.filter("removed_at is not null")
    state = None
    for now in (lambda c: early(c), lambda c: ~early(c)):
        state = R.maintain(state, R.reference_deltas(refs.filter(now("at"))), R.insert_deltas(records.filter(now("seen_at"))), R.removal_deltas(gone.filter(now("removed_at"))))
    return R.report(R.orphans(refs, state))


_SQL = r"""
WITH refs AS (
  SELECT 'cross_references' AS ref_table, 'target_path' AS ref_field, CAST(ref_id AS VARCHAR) AS ref_key, 'path' AS kind, corpus_version,
         regexp_replace(regexp_replace(target_path, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '', 'g'), '^(section|sec\.?|s\.|u/s)', '', 'i') AS key, target_path AS raw, extracted_at AS at
  FROM cross_references
  UNION SELECT 'cross_references', 'from_path', CAST(ref_id AS VARCHAR), 'path', corpus_version,
         regexp_replace(regexp_replace(from_path, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '', 'g'), '^(section|sec\.?|s\.|u/s)', '', 'i'), from_path, extracted_at
  FROM cross_references
  UNION SELECT 'chunk_embeddings', 'chunk_id', chunk_id, 'id', corpus_version, chunk_id, chunk_id, created_at FROM chunk_embeddings
), recs AS (
  SELECT kind, corpus_version, key, bool_and(removed_at IS NOT NULL) AS gone, min(ingested_at) AS seen FROM (
    SELECT 'path' AS kind, corpus_version,
           regexp_replace(regexp_replace(node_path, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '', 'g'), '^(section|sec\.?|s\.|u/s)', '', 'i') AS key, ingested_at, removed_at FROM chunks
    UNION ALL SELECT 'id', corpus_version, chunk_id, ingested_at, removed_at FROM chunks
  ) GROUP BY ALL
), judged AS (
  SELECT ref_table, ref_field, ref_key,
         CASE WHEN c.key IS NULL THEN 'missing' WHEN c.gone THEN 'deleted' WHEN c.seen > r.at THEN 'late' END AS reason,
         coalesce(strftime(r.at AT TIME ZONE 'UTC', '%Y-%m'), 'unknown') AS period
  FROM refs r LEFT JOIN recs c ON r.kind = c.kind AND r.key = c.key AND r.corpus_version IS NOT DISTINCT FROM c.corpus_version
  WHERE r.raw IS NOT NULL AND regexp_replace(r.raw, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '', 'g') <> ''
)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_maintained": p1_maintained}
SQL = {
    "p1_found": _SQL + "SELECT ref_table, ref_field, ref_key, reason, period FROM judged WHERE reason IS NOT NULL",
    "p1_maintained": _SQL + "SELECT ref_table, ref_field, period, reason, count(*) AS orphans FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "p1_report": _SQL + "SELECT ref_table, ref_field, period, reason, count(*) AS orphans FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
}
