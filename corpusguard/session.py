"""Session set-up, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes a join side may have to be sent to every executor.
BROADCAST_LIMIT = 32 * 1024 * 1024


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the jobs rely on; everything else is the cluster's choice."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local masters."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="corpusguard-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back.

    Cuts the lineage on shared storage, so a lost executor re-reads files rather
    than re-running the scan, and gives the planner true sizes for its broadcast
    decision.
    """
    target = new_folder(df.sparkSession, name)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; enormous where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit_bytes: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only if the size estimate is under the limit.

    Over the limit the frame is returned as it is and the join shuffles.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit_bytes else df


def broadcast_if_measured_small(df: DataFrame, name: str, limit_bytes: int = BROADCAST_LIMIT) -> DataFrame:
    """As above for a side that meets document text.

    A large estimate often means an unknown size.  Shuffling all text is so much
    dearer than this side that it is written once and its true size decides.
    """
    if estimated_bytes(df) <= limit_bytes:
        return F.broadcast(df)
    return broadcast_if_small(materialize(df, name), limit_bytes)


def fill_cores(table: DataFrame) -> DataFrame:
    """Spread a stored table over all cores where its files give too few tasks.

    The rules are bound by CPU.  A table of many files has more splits than the
    cluster has cores and is returned as it is; only a small or badly split one pays
    for a shuffle.  For plain scans only: counting splits must not run a job.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
