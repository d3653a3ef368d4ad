"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import once, table
from . import bpe, garbled, neighbours, packing, personal, splitting


def _limit(spark: SparkSession, d: str, name: str) -> tuple[int, int]:
    row = table(spark, d, "token_limits").filter(F.col("limit_name") == name).select("max_tokens", "overlap_tokens").first()
    return row[0], row[1]


# problem 2


def _nearest(spark: SparkSession, d: str, complete: Column | None = None) -> DataFrame:
    chunks = table(spark, d, "chunk_embeddings").select(F.col("chunk_id").alias("key"), F.col("embedding").alias("vector"))
    questions = table(spark, d, "query_vectors").select(F.col("query_id").alias("key"), F.col("vectors").alias("vector"))
    return neighbours.nearest(chunks, questions, complete=complete)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cosine 0.90 or more of which one is among the 10 most similar chunk vectors of the other."""
    return _nearest(spark, d).select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ranked neighbours of every vector with their cosines: those of 0.90 and more, and all 10, however far, of the searching set: all questions, and the
    chunks whose id, a hexadecimal number, is divisible by 100."""
    searching = (F.col("kind") == "q") | (F.conv("key", 16, 10).cast("decimal(20,0)") % 100 == 0)
    return _nearest(spark, d, complete=searching).select("kind", "key", "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


# problem 3


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """All texts of the turn tables, once each row."""
    labelled = once(table(spark, d, "labelled_turns", "turn_id", "turn"), ["turn_id"]).select(F.lit("labelled_turns").alias("source_table"), F.col("turn_id").alias("row_key"), F.col("turn").alias("text"))
    asked = once(table(spark, d, "turn_requests", "request_id", "question"), ["request_id"]).select(
        F.lit("turn_requests").alias("source_table"), F.col("request_id").cast("string").alias("row_key"), F.col("question").alias("text")
    )
    return labelled.unionByName(asked)


def _personal(spark: SparkSession, d: str) -> DataFrame:
    return personal.find(_turns(spark, d), table(spark, d, "name_lexicon"), ["source_table", "row_key"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every item of personal information, with its place."""
    found = _personal(spark, d).select("source_table", "row_key", F.explode("spans").alias("s"))
    return found.select("source_table", "row_key", "s.kind", "s.start_char", "s.end_char")


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders."""
    return personal.redact(_personal(spark, d), ["source_table", "row_key"])


# problem 4


def _over(spark: SparkSession, d: str, limit: int) -> DataFrame:
    """Chunks over the limit, counted anew, once each."""
    chunks = table(spark, d, "chunks", "chunk_id", "text").filter(splitting.token_count(F.col("text")) > limit)
    return once(chunks, ["chunk_id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the splitter cuts into more than one piece."""
    limit, overlap = _limit(spark, d, "piece")
    return splitting.split_texts(_over(spark, d, limit), ["chunk_id"], "text", limit, overlap).filter("piece = 1").select("chunk_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all chunks."""
    limit, overlap = _limit(spark, d, "piece")
    return splitting.split_texts(once(table(spark, d, "chunks", "chunk_id", "text"), ["chunk_id"]), ["chunk_id"], "text", limit, overlap)


def p4_claims(spark: SparkSession, d: str) -> DataFrame:
    """What token_count and over_context claim, against what is so, per corpus version."""
    limit, _ = _limit(spark, d, "piece")
    n = splitting.token_count(F.col("text"))
    chunks = once(table(spark, d, "chunks").select("chunk_id", "corpus_version", "token_count", n.alias("n"), "removed_at"), ["chunk_id", "corpus_version"])
    counted = chunks.groupBy("corpus_version").agg(
        F.count_if(F.col("n") > limit).alias("over"), F.count_if(F.col("token_count") > limit).alias("over_by_token_count"),
        F.count_if(~F.col("token_count").eqNullSafe(F.coalesce("n", F.lit(0)))).alias("wrong_token_count"),
    )
    stats = once(table(spark, d, "chunk_statistics", "corpus_version", "over_context", "built_at"), ["corpus_version", "over_context"])
    last = stats.groupBy("corpus_version").agg(F.max_by("over_context", "built_at").alias("claimed"))
    return counted.join(last, "corpus_version", "left").withColumn("claim_holds", F.col("over").eqNullSafe(F.col("claimed")))


# problem 6


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each document's text."""
    return bpe.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents that do not come back from their ids; none should be."""
    back = bpe.decode_column(p6_ids(spark, d), "doc_id", "ids").withColumnRenamed("text", "back")
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.join(back, "doc_id").filter(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("back"))).select("doc_id")


# problem 7


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container, in parts where it alone exceeds one."""
    limit, _ = _limit(spark, d, "container")
    return packing.pack(bpe.count_column(table(spark, d, "documents"), "doc_id", "text"), "doc_id", limit)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(p7_containers(spark, d), _limit(spark, d, "container")[0])


# problem 8


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least one garbled sequence."""
    return garbled.repair(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with what was found in them and their restored texts."""
    return garbled.repair(table(spark, d, "documents"), "doc_id", "text")


_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]'))"
SQL = {
    "p4_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE {_TOKENS} > (SELECT max_tokens FROM token_limits WHERE limit_name = 'piece')",
    "p4_claims": f"""
WITH c AS (SELECT chunk_id, corpus_version, min(token_count) AS token_count, min({_TOKENS}) AS n FROM chunks GROUP BY ALL),
lim AS (SELECT max_tokens AS m FROM token_limits WHERE limit_name = 'piece'),
k AS (SELECT corpus_version, count(*) FILTER (n > m) AS over, count(*) FILTER (token_count > m) AS over_by_token_count,
             count(*) FILTER (token_count IS DISTINCT FROM coalesce(n, 0)) AS wrong_token_count FROM c, lim GROUP BY corpus_version),
s AS (SELECT corpus_version, arg_max(over_context, built_at) AS claimed FROM (SELECT corpus_version, over_context, min(built_at) AS built_at FROM chunk_statistics GROUP BY ALL) GROUP BY corpus_version)
SELECT k.*, s.claimed, k.over IS NOT DISTINCT FROM s.claimed AS claim_holds FROM k LEFT JOIN s USING (corpus_version)""",
    "p6_round_trip": "SELECT doc_id FROM documents WHERE false",
}
QUERIES = {q.__name__: q for q in (p2_found, p2_neighbours, p3_found, p3_redacted, p4_found, p4_pieces, p4_claims, p6_ids, p6_round_trip, p7_containers, p7_fill, p8_found, p8_restored)}
