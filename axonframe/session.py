"""Session settings, durable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a summary table may have before it is no longer sent to every executor.
BROADCAST_ROWS = 50_000
UNKNOWN_BYTES = 1 << 62


def get_spark(app: str = "axonframe", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC timestamps and adaptive execution; ANSI mode stays on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="axonframe-checkpoint-")
    sc.setCheckpointDir(shared)


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so that it survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a plan (file sizes where nothing better is known); no job is run.

    Estimates of joins are products, so long plans can exceed any number worth reading.
    """
    try:
        return min(int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), UNKNOWN_BYTES)
    except ValueError:  # more digits than Python converts
        return UNKNOWN_BYTES


def auto_broadcast_bytes(spark: SparkSession) -> int:
    """Size up to which Spark broadcasts a join side by itself."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if ``df`` has at most ``limit`` rows; else leave the join to Spark.

    The count stops after ``limit + 1`` rows.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame, *keys: str, bytes_per_task: int = 64 << 20) -> DataFrame:
    """Hash-partition ``df`` for a step whose cost is CPU, not bytes.

    The number of partitions is stated, so that adaptive execution does not merge them: at least
    four per core, more if the data is large.
    """
    return df.repartition(fan_out(df, bytes_per_task), *keys)


def fan_out(df: DataFrame, bytes_per_task: int = 64 << 20) -> int:
    """Partitions for a CPU-bound step: by the size of the files read, the partitions of checkpointed
    inputs (whose size estimates are only guesses), and the cores at hand."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    by_size = parts = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            by_size += int(str(leaf.stats().sizeInBytes()))
        elif leaf.getClass().getSimpleName() == "LogicalRDD":
            parts = max(parts, leaf.rdd().getNumPartitions())
    cores = spark.sparkContext.defaultParallelism
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores, parts, min(by_size // bytes_per_task, 20_000))
