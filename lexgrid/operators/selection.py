"""Choosing among rows: parameters, competing sources, causes of misses, first failing checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_parameters(scores: DataFrame, score: str, parameters: list[str], prefer: tuple | None = None, tolerance: float = 1e-9) -> DataFrame:
    """The parameters of the best score; of those within the tolerance the preferred ones, else the least. No row for an empty table."""
    top = scores.withColumn("_best", F.max(score).over(Window.partitionBy(F.lit(1))))
    near = top.filter(F.col(score) >= F.col("_best") - tolerance)  # one row a parameter setting: a small table
    wanted = F.lit(False) if prefer is None else reduce(lambda a, b: a & b, [F.col(p) == F.lit(v) for p, v in zip(parameters, prefer)])
    return near.orderBy((~wanted).cast("int"), *parameters).limit(1).select(*parameters, score)


def first_source(key: list[str], *sources: DataFrame) -> DataFrame:
    """Each key's row from the first source that has it; sources have the same columns, and a key once at most."""
    each = reduce(DataFrame.unionByName, [s.withColumn("_s", F.lit(i)) for i, s in enumerate(sources)])
    rest = [c for c in sources[0].columns if c not in key]
    return each.groupBy(*key).agg(F.min_by(F.struct(*rest), "_s").alias("_r"), F.min("_s").alias("source")).select(*key, "_r.*", "source")


def first_failing(checks: dict[str, Column]) -> Column:
    """The name of the first check that does not hold, or null; a check that is null does not hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])


def rates(df: DataFrame, by: list[str], shares: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Shares per group: rows that hold among rows that count; null where none counts."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.round(F.try_divide(F.count_if(ok & among), F.count_if(among)), 6).alias(n) for n, (ok, among) in shares.items()])
