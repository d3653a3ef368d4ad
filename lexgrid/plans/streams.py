"""Streams run to the end of their input, with their results as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import own_dir
from ..streaming import state as S


def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table, be it one file or a folder of files, as a stream; times without a zone are UTC."""
    batch = spark.read.parquet(f"{d}/{table}.parquet")
    is_file = batch.inputFiles()[:1] and batch.inputFiles()[0].endswith(f"/{table}.parquet")
    reader = spark.readStream.schema(batch.schema).option("pathGlobFilter", f"{table}.parquet" if is_file else "*.parquet")
    stream = reader.parquet(d if is_file else f"{d}/{table}.parquet")
    return stream.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in stream.dtypes])


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote."""
    spark, at = stream.sparkSession, f"{own_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{at}/rows")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/rows")


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type; in update mode the last row of a window holds."""
    rows = _run(S.window_counts(_stream(spark, d, "events"), "ts", "1 day", ["event_type"], "3650 days"), "update")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "_batch").alias("n"))


def stream_fact_state(spark: SparkSession, d: str) -> DataFrame:
    e = _stream(spark, d, "events")
    e = e.withColumns({"status": F.when(F.col("event_type") == "purchase", "stated").when(F.col("event_type") == "click", "inferred").otherwise("missing"), "field": F.pmod("event_id", F.lit(3)), "v": F.col("event_id")})
    rows = _run(S.fact_state(e, "user_id", "field", "status", "event_id", "v"), "update")
    return rows.groupBy("user_id", "field").agg(F.max_by(F.struct("status", "value"), "_batch").alias("r")).select("user_id", "field", "r.status", "r.value")


def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user within an hour, one by one."""
    return _run(S.rate_limit(_stream(spark, d, "events"), "user_id", "event_id", "ts", 3600, 5), "update").select("user_id", "event_id", "in_window", "refused")


SQL = {
    "stream_window_counts": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_fact_state": "SELECT user_id, field, status, CAST(event_id AS VARCHAR) AS value FROM (SELECT event_id, user_id, event_id % 3 AS field, CASE event_type WHEN 'purchase' THEN 'stated' WHEN 'click' THEN 'inferred' ELSE 'missing' END AS status FROM events) WHERE status <> 'missing' QUALIFY row_number() OVER (PARTITION BY user_id, field ORDER BY status = 'stated' DESC, event_id DESC) = 1",
}
QUERIES = {q.__name__: q for q in (stream_window_counts, stream_fact_state, stream_rate_limit)}
