"""Constraints as queries: one row per broken rule, (rule, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Rules are conditions that must hold; a condition that is null does not hold. One pass over the table."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def not_unique(df: DataFrame, columns: list[str], rule: str) -> DataFrame:
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    return df.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.lit(rule).alias("rule"), key.alias("key"))


def without_parent(df: DataFrame, key: str, columns: list[str], parents: DataFrame, rule: str) -> DataFrame:
    """Rows whose columns (none null) are no row of parents, whose columns must be named alike."""
    return df.dropna(subset=columns).join(parents.select(*columns).distinct(), columns, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
