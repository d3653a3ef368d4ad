"""Parquet tables by name, and the removal of repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def once(df: DataFrame, key: list[str], *columns: str) -> DataFrame:
    """One row per key: a repeat is the same row delivered again, so the least of its columns stands for all.

    Rows whose key columns are null form one group like any other key. Aggregates combine before the shuffle,
    so a key delivered very often is no hot group.
    """
    rest = [c for c in (columns or df.columns) if c not in key]
    if not rest:
        return df.select(*key).distinct()
    return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, *[F.col("_row").getField(c).alias(c) for c in rest])
