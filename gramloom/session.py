"""Session set-up and the few helpers that touch cluster settings."""

from __future__ import annotations

import gc
import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table may be broadcast when its rows take no more than this as JSON, which is longer than Spark's own form.
BROADCAST_BYTES = 64 << 20
PART_BYTES = 64 << 20


def build_session(app: str = "gramloom", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Session with adaptive execution; sizes are left to the cluster unless given in `conf`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_dir(spark: SparkSession) -> str:
    """Checkpoint folder named by the cluster; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):  # executors of their own, as in local-cluster, share no folder
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="gramloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder, so later steps neither recompute nor lose it."""
    _shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """`df` kept in the shared folder, so that using it twice does not compute it twice; a kept table stays as it is."""
    if getattr(df, "_is_settled", False):
        return df
    out = checkpointed(df)
    out._is_settled = True
    return out


def columnar(df: DataFrame) -> DataFrame:
    """Like `settled`, as a compressed table of columns in the scratch folder: a fraction of the space where values repeat."""
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._is_settled = True
    return out


def release(spark: SparkSession) -> None:
    """Has shuffles and checkpoints of tables that nothing uses any more removed now, not when the driver runs out of heap."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for tables a job writes and reads back; `clear_scratch` removes them."""
    return f"{_scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_dir(spark: SparkSession) -> str:
    return f"{_shared_dir(spark).rstrip('/')}/scratch/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes the tables that jobs of this application have written for themselves; results read from them end with it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_scratch_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows of a scan over all cores, only where the scan has fewer splits than cores.

    Large inputs already come in many splits and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(2 * cores, *keys) if splits < cores else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows of a settled table by key into parts of about 64 MB, by their measured size.

    There are never fewer parts than shuffles use by default, nor too few to keep all cores busy. The planner's guess is not
    asked: for joins of kept tables it is a product, which once made hundreds of thousands of parts of a small table.
    """
    spark = df.sparkSession
    df = settled(df)
    by_size = math.ceil(measured(df)[0] / PART_BYTES)
    by_conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(by_size, by_conf, 2 * spark.sparkContext.defaultParallelism), *keys)


def measured(df: DataFrame) -> tuple[int, int]:
    """(bytes as JSON, rows) of a settled table; every task sends two sums."""
    size, n = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.count("*")).first()
    return size or 0, n


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """True when the rows of a settled table take at most `limit` bytes."""
    return measured(df)[0] <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A settled form of `df`, marked for broadcast if its measured size allows it."""
    df = settled(df)
    return F.broadcast(df) if is_small(df, limit) else df
