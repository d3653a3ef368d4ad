"""Combining rankings (query_id, item_id, rank, score). An item stands once in a ranking; a query without rows has no ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value.
RRF_K = 60


def _union(*rankings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.select("query_id", "item_id", "rank", "score").withColumn("source", F.lit(i)) for i, r in enumerate(rankings)])


def _renumber(df: DataFrame, *order, k: int | None = None) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    ranked = ranked if k is None else ranked.filter(F.col("rank") <= k)
    return ranked.select("query_id", "item_id", "rank", "score")


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """scores(query_id, item_id, score) as a ranking; ties go to the smaller item_id."""
    return _renumber(scores, F.desc("score"), "item_id", k=k)


def rrf(*rankings: DataFrame, k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion; ties go to the best single rank, then to the earlier ranking. Sums are exact decimals."""
    each = _union(*rankings).withColumn("part", (F.lit(1).cast("decimal(20,18)") / (F.col("rank") + rrf_k).cast("decimal(10,0)")).cast("decimal(28,20)"))
    fused = each.groupBy("query_id", "item_id").agg(F.sum("part").alias("sum"), F.min(F.struct("rank", "source")).alias("best"))
    return _renumber(fused.withColumn("score", F.col("sum").cast("double")), F.desc("sum"), "best.rank", "best.source", "item_id", k=k)


def fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first ranking, and the second one for queries that the first has nothing for."""
    return first.unionByName(second.join(first.select("query_id").distinct(), "query_id", "left_anti"))


def rerank(ranking: DataFrame, scores: DataFrame, head: int = 20) -> DataFrame:
    """The first `head` items sorted anew by scores(query_id, item_id, new_score), unscored ones last; the tail keeps its order; the score becomes the number of items below plus one."""
    size = F.count("*").over(Window.partitionBy("query_id"))
    joined = ranking.join(scores.select("query_id", "item_id", "new_score"), ["query_id", "item_id"], "left").withColumn("_n", size)
    in_head = F.col("rank") <= head
    order = [(~in_head).cast("int"), F.when(in_head, F.col("new_score")).desc_nulls_last(), F.col("rank")]
    again = joined.withColumn("_p", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return again.select("query_id", "item_id", F.col("_p").alias("rank"), (F.col("_n") - F.col("_p") + 1).cast("double").alias("score"))


def prepend(hits: DataFrame, ranking: DataFrame, k: int | None = None) -> DataFrame:
    """Hits first, then the ranking without what the hits have."""
    each = _union(hits, ranking)
    first = each.groupBy("query_id", "item_id").agg(F.min(F.struct("source", "rank", "score")).alias("b")).select("query_id", "item_id", "b.*")
    return _renumber(first, "source", "rank", "item_id", k=k)


def interleave(*rankings: DataFrame, k: int | None = None) -> DataFrame:
    """The i-th items of all rankings in turn; an item counts where it first stands."""
    each = _union(*rankings).groupBy("query_id", "item_id").agg(F.min(F.struct("rank", "source", "score")).alias("b")).select("query_id", "item_id", "b.*")
    return _renumber(each, "rank", "source", "item_id", k=k)
