"""References to records that do not exist.

Signed counts per key, maintained from change deltas: a reference adds +1 to the reference count of its key and its retraction -1; a record adds +1
to the row count and to the existence count of its key and its removal -1 to the latter. A key with references and no existence is
an orphan, and its references form the report. Counts are plain sums, so a batch of deltas folds into the stored state of the earlier ones, in any order
(`maintain`), and the state is never computed anew.

Defined results: rows with a null or blank key are no references; a null scope is a scope like any other (compared
null-safely); a null reference time is never `late` and reported under period `unknown`; repeated rows must be
removed beforehand (sources.tables.once). Empty tables give empty reports; extra columns are ignored. After a retraction `first_ref` is a lower bound: it only
chooses the keys to look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: White space of any kind, as Java's regular expressions need it spelled out.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: Leading words for "section" in front of a citation.
LEAD = r"(?i)^(?:section|sec\.?|s\.|u/s)"
STATE = ["scope", "key", "refs", "rows", "live", "first_seen", "first_ref"]


def same_citation(path: Column) -> Column:
    """The form in which two spellings of one citation are equal: no white space, no leading word for section. Null stays null."""
    return F.regexp_replace(F.regexp_replace(path, SPACE + "+", ""), LEAD, "")


def blank(path: Column) -> Column:
    return path.isNull() | (F.regexp_replace(path, SPACE + "+", "") == "")


def _delta(df: DataFrame, refs: int, rows: int, live: int, seen: Column, ref: Column) -> DataFrame:
    long = lambda n: F.lit(n).cast("long")
    return df.select("scope", "key", long(refs).alias("refs"), long(rows).alias("rows"), long(live).alias("live"), seen.cast("timestamp").alias("first_seen"), ref.cast("timestamp").alias("first_ref"))


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """refs(scope, key, at) -> one delta per reference; sign -1: they are retracted."""
    return _delta(refs, sign, 0, 0, F.lit(None), F.col("at"))


def insert_deltas(records: DataFrame) -> DataFrame:
    """records(scope, key, seen_at) -> one delta per new record."""
    return _delta(records, 0, 1, 1, F.col("seen_at"), F.lit(None))


def removal_deltas(records: DataFrame) -> DataFrame:
    """records(scope, key) -> one delta per record that is removed."""
    return _delta(records, 0, 0, -1, F.lit(None), F.lit(None))


def record_deltas(records: DataFrame) -> DataFrame:
    """records(scope, key, seen_at, removed_at) -> one delta per record, its removal already folded in."""
    gone = F.col("removed_at").isNotNull()
    return records.select(
        "scope", "key", F.lit(0).cast("long").alias("refs"), F.lit(1).cast("long").alias("rows"), F.when(gone, 0).otherwise(1).cast("long").alias("live"),
        F.col("seen_at").cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("first_ref"),
    )


def fold(*deltas: DataFrame) -> DataFrame:
    """Sums deltas and earlier states into one state row per key; partial sums are formed before the shuffle."""
    together = deltas[0]
    for d in deltas[1:]:
        together = together.unionByName(d)
    return together.groupBy("scope", "key").agg(
        *[F.sum(c).alias(c) for c in ("refs", "rows", "live")],
        F.min("first_seen").alias("first_seen"), F.min("first_ref").alias("first_ref"),
    ).select(*STATE)


def maintain(state: DataFrame | None, *deltas: DataFrame) -> DataFrame:
    """The stored state after a batch of deltas: a table in the shared folder that the next batch starts from. Keys that nothing speaks of any more go."""
    folded = fold(*([state] if state is not None else []), *deltas)
    return materialize(folded.filter("refs <> 0 or rows <> 0 or live <> 0"))


def suspects(state: DataFrame) -> DataFrame:
    """Keys that are referred to and of which some reference is an orphan: no live record, or a reference before the first."""
    return state.filter((F.col("refs") > 0) & ((F.col("live") <= 0) | (F.col("first_ref") < F.col("first_seen"))))


def orphans(refs: DataFrame, state: DataFrame, hot_keys: int = 256, salts: int = 64) -> DataFrame:
    """refs(scope, key, at, ...) that nothing answers to, with `reason` (missing, deleted, late) and `period`.

    The hot_keys most cited suspect keys are salted on both sides. The list has hot_keys rows at most, so it may be
    broadcast; a key beyond it has less than one hot_keys-th of all references.
    """
    bad = materialize(suspects(state))  # used twice: the fold runs once
    hot = F.broadcast(bad.orderBy(F.desc("refs"), "scope", "key").limit(hot_keys).filter(F.col("refs") > 1000).select(F.col("scope").alias("_hs"), F.col("key").alias("_hk")))
    is_hot = F.col("_hk").isNotNull()
    on_hot = F.col("scope").eqNullSafe(F.col("_hs")) & (F.col("key") == F.col("_hk"))
    spread = bad.join(hot, on_hot, "left").withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hs", "_hk")
    salted = refs.join(hot, on_hot, "left").withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*refs.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hs", "_hk")
    s = spread.select(F.col("scope").alias("_s"), F.col("key").alias("_k"), F.col("_salt").alias("_t"), "rows", "live", "first_seen")
    hit = salted.join(s, F.col("scope").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_k")) & (F.col("_salt") == F.col("_t")))
    reason = F.when(F.col("rows") == 0, "missing").when(F.col("live") <= 0, "deleted").when(F.col("first_seen") > F.col("at"), "late")
    return (
        hit.withColumn("reason", reason).filter(F.col("reason").isNotNull())
        .withColumn("period", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")))
        .drop("_s", "_k", "_t", "_salt", "rows", "live", "first_seen")
    )


def report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, period and reason."""
    return found.groupBy("ref_table", "ref_field", "period", "reason").agg(F.count("*").alias("orphans"))
