"""Scoring rankings, predictions and raters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P


def retrieval_scores(ranking: DataFrame, gold: DataFrame, k: int, lenient: bool = True) -> DataFrame:
    """ranking(query_id, rank, path), gold(query_id, required) -> (query_id, required, recall, mrr, ndcg) of every query of gold.

    Repeated paths of a ranking count at their first place. A result gains 1 if it credits a required path that none before
    it did; recall counts required paths; the ideal has all required paths, uncut by k.
    """
    top = ranking.groupBy("query_id", "path").agg(F.min("rank").alias("rank"))
    place = Window.partitionBy("query_id").orderBy("rank", "path")
    top = top.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    wanted = gold.select("query_id", "required").distinct()
    ways = wanted.select("query_id", "required", F.explode(P.prefixes(F.col("required"))).alias("path")) if lenient else wanted.withColumn("path", F.col("required"))
    first = ways.join(top, ["query_id", "path"], "left").groupBy("query_id", "required").agg(F.min("rank").alias("rank"))
    gain = lambda r: F.lit(1.0) / F.log2(r + 1.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.count("*").cast("int")), F.lit(0.0), lambda s, i: s + gain(i.cast("double")))
    dcg = F.aggregate(F.array_sort(F.collect_set("rank")), F.lit(0.0), lambda s, r: s + gain(r.cast("double")))
    return first.groupBy("query_id").agg(
        F.count("*").alias("required"), (F.count("rank") / F.count("*")).alias("recall"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr"), (dcg / ideal).alias("ndcg")
    )


def by_slice(scores: DataFrame, slices: DataFrame) -> DataFrame:
    """Means per slice and overall (slice `all`); a null slice is `none`."""
    joined = scores.join(slices.select("query_id", F.coalesce("slice", F.lit("none")).alias("slice")), "query_id")
    means = joined.rollup("slice").agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")])
    return means.withColumn("slice", F.coalesce("slice", F.lit("all")))


def agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per query of either ranking: identical, reordered or different sets of the first k, and their overlap."""
    cut = lambda r, c: r.filter(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias(c))
    none = F.array().cast("array<string>")
    both = cut(a, "x").join(cut(b, "y"), "query_id", "full_outer").select("query_id", F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    kind = F.when(F.col("x") == F.col("y"), "identical").when((shared == F.size("x")) & (shared == F.size("y")), "reordered").otherwise("different")
    return both.select("query_id", kind.alias("kind"), shared.alias("shared"), F.try_divide(shared, F.size(F.array_union("x", "y"))).alias("jaccard"))


def counts(gold: DataFrame, found: DataFrame, key: list[str], value: str) -> DataFrame:
    """True and false positives and misses per value of `value`'s kind and overall; a pair is right if key and value agree."""
    joined = gold.select(*key, F.col(value).alias("_g")).join(found.select(*key, F.col(value).alias("_f")), key, "full_outer")
    right = F.col("_g").eqNullSafe(F.col("_f")) & F.col("_g").isNotNull()
    rolled = joined.rollup(key[-1]).agg(
        F.count_if(right).alias("tp"), F.count_if(F.col("_f").isNotNull() & ~right).alias("fp"), F.count_if(F.col("_g").isNotNull() & ~right).alias("fn")
    ).withColumn(key[-1], F.coalesce(key[-1], F.lit("all")))
    ratio = lambda x, y: F.round(F.coalesce(F.try_divide(F.col(x), F.col(x) + F.col(y)), F.lit(0.0)), 6)
    f1 = F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6)
    return rolled.select("*", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"), f1.alias("f1"))


def kappa(a: Column, b: Column) -> Column:
    """Cohen's kappa of two booleans, as an aggregate; 1 where chance alone agrees fully, null over nothing."""
    mean = lambda c: F.avg(c.cast("double"))
    seen = mean(a == b)
    chance = mean(a) * mean(b) + (1 - mean(a)) * (1 - mean(b))
    return F.when(chance == 1, F.lit(1.0)).otherwise((seen - chance) / (1 - chance))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation with average ranks for ties, per group."""
    def average_rank(c: str) -> Column:
        first = F.rank().over(Window.partitionBy(*by).orderBy(c))
        return first + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0

    ranked = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, average_rank(x).alias("_x"), average_rank(y).alias("_y"))
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("spearman"))


def percentiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The three nearest-rank rules: floor(q n), round(q (n - 1)) to even, ceil(q n) - 1, at 0.5, 0.9, 0.95 and 0.99, over distinct counts of each value."""
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    running = counted.select(*by, value, F.sum("c").over(order).alias("upto"), F.sum("c").over(Window.partitionBy(*by)).alias("_n"))
    rules = []
    for q in (0.5, 0.9, 0.95, 0.99):
        name = f"{round(q * 100)}"
        place = {"floor": F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1), "even": F.bround(F.lit(q) * (F.col("_n") - 1), 0), "ceil": F.ceil(F.lit(q) * F.col("_n")) - 1}
        rules += [F.min(F.when(F.col("upto") > p, F.col(value))).alias(f"{k}_{name}") for k, p in place.items()]
    return running.groupBy(*by).agg(*rules)


def verdict(conditions: dict[str, Column], more: Column | None = None) -> tuple[Column, Column]:
    """A decision and the reasons against it: conditions are what must hold, more is an array of further reasons."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions.items()]))
    reasons = reasons if more is None else F.concat(reasons, more)
    return F.size(reasons) == 0, reasons


#: Fixed value: means of equal runs can differ in their last bits.
TOLERANCE = 1e-9


def judge(candidate: DataFrame, incumbent: DataFrame, slices: DataFrame) -> DataFrame:
    """Whether a run may replace another, both (query_id, recall, ndcg) of the same queries: neither mean falls, one rises, and no slice loses more
    than one query of recall. One row (old_recall, old_ndcg, new_recall, new_ndcg, adopted, reasons ARRAY); a null slice is `none`.
    """
    side = lambda df, name: df.select("query_id", *[F.col(c).alias(f"{name}_{c}") for c in ("recall", "ndcg")])
    each = side(incumbent, "old").join(side(candidate, "new"), "query_id").join(slices.select("query_id", "slice"), "query_id", "left")
    names = [f"{run}_{c}" for run in ("old", "new") for c in ("recall", "ndcg")]
    by = each.groupBy(F.coalesce("slice", F.lit("none")).alias("slice")).agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in names])
    lost = F.col("old_recall") - F.col("new_recall")
    loses = F.when(lost > 1 + TOLERANCE, F.format_string("slice_loses:%s:%.2f", "slice", lost))
    both = by.agg(*[F.coalesce(F.try_divide(F.sum(c), F.sum("_n")), F.lit(0.0)).alias(c) for c in names], F.array_sort(F.collect_list(loses)).alias("_loses"))
    holds = lambda c: F.col(f"new_{c}") >= F.col(f"old_{c}") - TOLERANCE
    rises = (F.col("new_recall") > F.col("old_recall") + TOLERANCE) | (F.col("new_ndcg") > F.col("old_ndcg") + TOLERANCE)
    adopted, reasons = verdict({"recall_falls": holds("recall"), "ndcg_falls": holds("ndcg"), "nothing_rises": rises}, F.col("_loses"))
    return both.select(*names, adopted.alias("adopted"), reasons.alias("reasons"))
