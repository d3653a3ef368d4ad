"""Session set-up and the two ways of cutting lineage that survive the loss of an executor."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexgrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lexgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lexgrid-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(_delete, spark, path)
    return path


_OWN: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may have ended already
        pass


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Writes df once to this application's part of the shared folder and reads it back: lineage is cut and the work is done once.

    Dataset.checkpoint() computes an uncached plan twice; a written table also keeps column pruning for its readers. `forget` deletes it once nothing reads it any more,
    else it goes with the application.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/table-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a materialized table that nothing will read again; other frames are left alone."""
    if path := getattr(df, "_materialized", None):
        _delete(df.sparkSession, path)


#: Bytes of input, as the optimizer estimates them, of a partition of costly work; and the most partitions a core.
PARTITION_BYTES, PARTITIONS_A_CORE = 64 << 20, 64


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out to all cores, for work that costs far more than moving its input. A scan of many splits stays as it is;
    behind a shuffle the sizes of partitions follow their bytes, not the work on them, so the rows are dealt out anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    shuffled = plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec"
    if not shuffled and plan.outputPartitioning().numPartitions() >= 2 * cores:
        return df
    size = float(str(execution.optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(3 * cores, min(math.ceil(size / PARTITION_BYTES), PARTITIONS_A_CORE * cores)))
