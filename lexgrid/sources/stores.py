"""Stores with a manifest: what was written can be checked before it is used.

Digests are over the rows in the order of an ordinal, so a store has the same digest however its files are split.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.joins import reconcile


class StoreMismatch(ValueError):
    """A store is not what its manifest or its reader says."""


def digest(df: DataFrame, ordinal: str, buckets: int = 1024) -> str:
    """sha256 over the hashes of the rows: rows are hashed in order within buckets of the ordinal's rank range, then the buckets'
    hashes in order, so no task holds more than a bucket's hashes of 64 characters."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    hashed = df.select(F.col(ordinal).cast("bigint").alias("_o"), row.alias("_h"))
    top = hashed.agg(F.max("_o")).first()[0] or 0
    width = max(1, -(-(top + 1) // buckets))
    joined = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h"))), lambda x: x["_h"]))
    parts = hashed.groupBy(F.floor(F.col("_o") / width).alias("_b")).agg(F.sha2(joined, 256).alias("_d"))
    done = parts.agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda x: x["_d"])), 256)).first()[0]
    return done


def corpus_version(source: str, stages: dict[str, int], artifact: str) -> str:
    """A version that follows from the source's hash, the stages' versions and the artifact's hash."""
    from hashlib import sha256

    text = json.dumps({"artifact_sha256": artifact, "source_sha256": source, "stage_versions": stages}, sort_keys=True, separators=(",", ":"))
    return sha256(text.encode()).hexdigest()


def write_jsonl(df: DataFrame, path: str, ordinal: str, **manifest: object) -> dict:
    """Writes rows as JSON lines and a manifest with count and digest beside them."""
    df.select(*sorted(df.columns)).write.json(f"{path}/rows")
    found = {"count": df.count(), "sha256": digest(df, ordinal), **manifest}
    df.sparkSession.createDataFrame([(json.dumps(found, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return found


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def read_jsonl(spark: SparkSession, path: str, schema: StructType, ordinal: str, **expected: object) -> DataFrame:
    """Reads a store of write_jsonl; refuses if a row does not fit the schema or the manifest does not hold or differs from what is expected."""
    manifest = read_manifest(spark, path)
    if wrong := {k: (v, manifest.get(k)) for k, v in expected.items() if manifest.get(k) != v}:
        raise StoreMismatch(f"{path}: {wrong}")
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/rows")
    if df.count() != manifest["count"] or digest(df, ordinal) != manifest["sha256"]:
        raise StoreMismatch(f"{path}: rows are not those of the manifest")
    return df


def read_versioned(spark: SparkSession, path: str, version: int, schema: str) -> DataFrame:
    """One JSON document {version, entries}; the entries as rows. Another version is refused."""
    df = spark.read.option("multiLine", True).schema(f"version int, entries array<struct<{schema}>>").json(path)
    found = {r[0] for r in df.select("version").distinct().collect()}
    if found != {version}:
        raise StoreMismatch(f"{path}: version {found}, not {version}")
    return df.select(F.explode("entries").alias("e")).select("e.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Text files as pages: (path, page from 0, text, sha256); form feeds part the pages of a file."""
    df = spark.read.format("binaryFile").load(path)
    pages = df.select("path", F.sha2("content", 256).alias("sha256"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("page", "text"))
    return pages.select("path", "page", "text", "sha256")


def ingest(chunks: DataFrame, vectors: DataFrame, path: str) -> str:
    """Writes chunks, edges and vectors of new corpus versions under path, once: `written`, or `present` where the same versions are there already; differing ones are refused."""
    spark = chunks.sparkSession
    problems = reconcile(chunks.select("corpus_version", "chunk_id"), vectors.select("corpus_version", "chunk_id"), ["corpus_version", "chunk_id"])
    if not problems.isEmpty():
        raise StoreMismatch(f"chunks and vectors do not match: {problems.limit(3).collect()}")
    new = chunks.groupBy("corpus_version").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("chunk_id", "text")).alias("h"))
    try:
        old = spark.read.parquet(f"{path}/versions")
    except Exception:  # nothing there yet
        old = None
    if old is not None:
        same = new.join(old.select("corpus_version", F.col("n").alias("_n"), F.col("h").alias("_h")), "corpus_version", "left")
        states = {r[0] for r in same.select(F.when(F.col("_n").isNull(), "new").when((F.col("n") == F.col("_n")) & (F.col("h") == F.col("_h")), "present").otherwise("differs")).distinct().collect()}
        if "differs" in states:
            raise StoreMismatch("a version is there with other rows")
        if states == {"present"}:
            return "present"
        chunks = chunks.join(old.select("corpus_version"), "corpus_version", "left_anti")
        vectors = vectors.join(old.select("corpus_version"), "corpus_version", "left_anti")
        new = new.join(old.select("corpus_version"), "corpus_version", "left_anti")
    chunks.write.mode("append").partitionBy("corpus_version").parquet(f"{path}/chunks")
    chunks.select("corpus_version", "chunk_id", F.posexplode("outgoing_refs").alias("position", "target_path")).write.mode("append").parquet(f"{path}/edges")
    vectors.write.mode("append").parquet(f"{path}/vectors")
    new.write.mode("append").parquet(f"{path}/versions")  # last: a version counts once all its rows are there
    return "written"


def migration_gaps(names: list[str]) -> list[int]:
    """Numbers that a series of numbered files 0001_... lacks."""
    have = {int(n[:4]) for n in names}
    return sorted(set(range(1, max(have, default=0) + 1)) - have)
