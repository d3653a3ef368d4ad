"""What many queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import once, table


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Live chunks, once each (a repeat is the same row with a later ingested_at)."""
    df = table(spark, d, "chunks").filter("removed_at is null")
    return once(df, ["chunk_id"], *(columns or [c for c in df.columns if c != "chunk_id"]))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Distinct questions, one row per query_id."""
    return once(table(spark, d, "query_vectors", "query_id", "slice", "question"), ["query_id"])


#: The same for the oracle.
CHUNKS = "(SELECT * FROM chunks WHERE removed_at IS NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) = 1)"
QUESTIONS = "(SELECT query_id, min(slice) AS slice, min(question) AS question FROM query_vectors GROUP BY query_id)"
