"""Filling fixed-capacity containers with items of varying length.

Cost-balanced packing: an item of n tokens costs n + n^2 / capacity (a linear part and the quadratic part of attention);
items are taken in descending size and each goes to the sequence of lowest cost that still has room. As many sequences
are open from the start as the total needs; another one is opened only when an item fits nowhere. Only an item larger
than the capacity is split: into full containers and a rest that is packed like any item.

Items are dealt by a hash of their key into packing groups of about `group` containers, each packed by one task, so no task
grows with the data and copies of one text spread over all groups. What lies in a group's emptiest container is taken out
again and packed together with that of the other groups, until one group is left.

Defined results: items of size zero or null take no room and get a null container; equal sizes go in the order of the
key; an empty table gives an empty result. The key must be unique.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def assign(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item; sizes are at most capacity each. An item of the full capacity gets a container of its own."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    count = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    room, cost = np.full(count, capacity, dtype=np.int64), np.zeros(count)
    out = [0] * len(sizes)
    for i in order:
        n = sizes[i]
        price = np.where(room >= n, cost, np.inf)
        k = int(price.argmin())
        if room[k] < n:
            k = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        room[k] -= n
        cost[k] += n + n * n / capacity
        out[i] = k
    return out


def pack(sized: DataFrame, key: str, capacity: int, group: int = 1024) -> DataFrame:
    """sized(key, tokens) -> (key, part, first_token, tokens, container): one row per item or part of a split item."""
    kind = sized.schema[key].dataType.simpleString()
    sized = materialize(sized.select(key, "tokens"))
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    some = sized.filter("tokens > 0")
    whole = F.floor(F.col("tokens") / capacity).cast("int")
    full = some.filter(F.col("tokens") > capacity).select(key, F.posexplode(F.sequence(F.lit(0), whole - 1)).alias("part", "_p")).select(
        key, F.col("part").cast("int"), (F.col("part").cast("bigint") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("tokens"),
        F.concat_ws("-", F.lit("full"), F.col(key).cast("string"), F.col("part").cast("string")).alias("container"),
    )
    split = F.col("tokens") > capacity
    rest = some.select(
        key, F.when(split, whole).otherwise(0).alias("part"), F.when(split, whole.cast("bigint") * capacity).otherwise(F.lit(0).cast("bigint")).alias("first_token"),
        F.when(split, F.col("tokens") % capacity).otherwise(F.col("tokens")).alias("tokens"),
    ).filter("tokens > 0")

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "part"], ignore_index=True)
        where = np.array(assign([int(x) for x in pdf["tokens"]], capacity))
        emptiest = int(np.bincount(where, pdf["tokens"]).argmin())
        return pdf[[key, "part", "first_token", "tokens"]].assign(container=[f"{group[1]}-{group[0]}-{k}" for k in where], again=where == emptiest)

    schema = f"`{key}` {kind}, part int, first_token bigint, tokens bigint, container string, again boolean"
    groups, turn, done = max(1, round(total / (group * capacity))), 0, []
    while True:
        dealt = rest.withColumn("_group", F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(groups)).cast("int")).withColumn("_turn", F.lit(turn))
        packed = dealt.groupBy("_group", "_turn").applyInPandas(run, schema)
        if groups == 1:
            done.append(packed.drop("again"))
            break
        packed = materialize(packed)
        done.append(packed.filter("not again").drop("again"))
        rest, groups, turn = packed.filter("again").select(rest.columns), max(1, groups // group), turn + 1
    none = sized.filter("tokens is null or tokens <= 0").select(
        key, F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("first_token"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.lit(None).cast("string").alias("container")
    )
    return reduce(DataFrame.unionByName, done).unionByName(full).unionByName(none)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, and the share of all room that is used."""
    used = packed.filter("container is not null").groupBy("container").agg(F.sum("tokens").alias("used"))
    return used.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.round(F.sum("used") / (F.count("*") * F.lit(capacity)), 6).alias("filled"), F.max("used").alias("fullest"),
    )
