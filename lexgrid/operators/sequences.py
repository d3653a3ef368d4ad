"""Operators over ordered rows. Every input has a group and an ordinal that is unique in its group; windows run per group.

A window needs a whole group in one task in order; groups here are texts, threads and rankings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 0, line); a null text has no lines, an empty one has an empty line."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _upto(group: str, order: str, last: int) -> Window:
    return Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, last)


def carry_forward(value: Column, group: str, order: str) -> Column:
    """The last value so far, this row's included."""
    return F.last(value, ignorenulls=True).over(_upto(group, order, 0))


def look_behind(value: Column, group: str, order: str) -> Column:
    """The last value before this row."""
    return F.last(value, ignorenulls=True).over(_upto(group, order, -1))


def look_ahead(value: Column, group: str, order: str) -> Column:
    """The next value after this row."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(1, Window.unboundedFollowing))


def islands(df: DataFrame, group: str, order: str, inside: Column) -> DataFrame:
    """Maximal runs of rows that hold: (group, first, last, rows)."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    held = df.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_n", place).filter("_in")
    run = held.withColumn("_run", F.col("_n") - F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return run.groupBy(group, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows")).drop("_run")


def missing_numbers(df: DataFrame, group: str, number: str) -> DataFrame:
    """Numbers of 1..max that a group lacks: (group, number)."""
    have = df.filter(F.col(number) >= 1).select(group, F.col(number).cast("bigint").alias("number")).distinct()
    gaps = have.withColumn("_next", F.lead("number").over(Window.partitionBy(group).orderBy("number")))
    first = have.groupBy(group).agg(F.min("number").alias("_m")).filter("_m > 1").select(group, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_m") - 1)).alias("number"))
    return first.unionByName(gaps.filter(F.col("_next") > F.col("number") + 1).select(group, F.explode(F.sequence(F.col("number") + 1, F.col("_next") - 1)).alias("number")))


def windows(lines: Column, sizes: Column, size: int) -> Column:
    """Whole lines in runs; a run is closed once it has `size` or more: ARRAY<STRUCT<first, last, total>> of line numbers from 0."""
    kind = "struct<done:array<struct<first:int,last:int,total:int>>,first:int,total:int,at:int>"
    start = F.struct(F.array().cast("array<struct<first:int,last:int,total:int>>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("total"), F.lit(0).alias("at")).cast(kind)

    def step(s: Column, n: Column) -> Column:
        total = s["total"] + F.coalesce(n.cast("int"), F.lit(0))
        closed = F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["at"].alias("last"), total.alias("total"))))
        full = total >= size
        return F.struct(F.when(full, closed).otherwise(s["done"]).alias("done"), F.when(full, s["at"] + 1).otherwise(s["first"]).alias("first"), F.when(full, 0).otherwise(total).alias("total"), (s["at"] + 1).alias("at")).cast(kind)

    def finish(s: Column) -> Column:
        return F.when(s["first"] < s["at"], F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (s["at"] - 1).alias("last"), s["total"].alias("total"))))).otherwise(s["done"])

    return F.aggregate(sizes, start, step, finish)


def in_window(df: DataFrame, key: str, at: str, seconds: int) -> Column:
    """Events of the key in the window of so many seconds that ends with this row's time: later than its start, strictly."""
    micros = F.unix_micros(at)
    return F.count("*").over(Window.partitionBy(key).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0))


def last_rows(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def first_seen(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Each value of a group where it first stands: (group, value, order)."""
    return df.groupBy(group, value).agg(F.min(order).alias(order))


def cap_per_kind(df: DataFrame, group: str, kind: str, order: str, limits: dict[str, int]) -> DataFrame:
    """At most so many rows of a kind in a group, the first ones; kinds without a limit keep all."""
    place = F.row_number().over(Window.partitionBy(group, kind).orderBy(order))
    cap = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn("_r", place).filter(F.coalesce(F.col("_r") <= F.try_element_at(cap, F.col(kind)), F.lit(True))).drop("_r")


def not_increasing(df: DataFrame, group: str, order: str, score: str) -> DataFrame:
    """Rows whose score is above the one before."""
    return df.withColumn("_b", F.lag(score).over(Window.partitionBy(group).orderBy(order))).filter(F.col(score) > F.col("_b")).drop("_b")


def merge_facts(df: DataFrame, entity: str, field: str, status: str, order: list[str]) -> DataFrame:
    """The state of each field: the latest stated row, else the latest inferred one; missing rows change nothing."""
    told = df.filter(F.col(status).isin("stated", "inferred"))
    return told.groupBy(entity, field).agg(F.max_by(F.struct(*df.columns), F.struct((F.col(status) == "stated"), *order)).alias("_r")).select("_r.*")


def overrides(df: DataFrame, entity: str, field: str, status: str, value: str, order: str) -> DataFrame:
    """Every replacement in the order of rows: (entity, field, order, was, now); an inferred row never replaces a stated one."""
    told = df.filter(F.col(status).isin("stated", "inferred"))
    before = Window.partitionBy(entity, field).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    stated_before = F.coalesce(F.max((F.col(status) == "stated").cast("int")).over(before), F.lit(0))
    accepted = told.withColumn("_s", stated_before).filter((F.col(status) == "stated") | (F.col("_s") == 0))
    was = F.lag(value).over(Window.partitionBy(entity, field).orderBy(order))
    seen = F.row_number().over(Window.partitionBy(entity, field).orderBy(order))
    return accepted.withColumn("was", was).withColumn("_n", seen).filter("_n > 1").select(entity, field, order, "was", F.col(value).alias("now"))
