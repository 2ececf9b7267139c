"""Session helpers: building a session for tests and tools, and finding the
shared folder used to cut lineage.

On a cluster ``spark.checkpoint.dir`` names a shared (HDFS / object store)
folder, which is read from the session.  Checkpoints and written tables stay
there until the cluster cleans that folder (or the session does, with
``spark.cleaner.referenceTracking.cleanCheckpoints``).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session for tests and tools.  ``master`` and ``partitions`` are the
    caller's choice; without them what spark-submit was given holds."""
    builder = (
        SparkSession.builder.appName("gridframe")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master is not None:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("GRIDFRAME_DRIVER_MEMORY", "16g"))
    if partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read from the running context first, then from ``spark.checkpoint.dir``.
    Only a local session (tests) may have none: it gets a fresh scratch folder.
    On a cluster such a folder would be on one machine, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="gridframe-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (for written tables)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table below the shared checkpoint folder and read it
    back: as ``cut_lineage``, for tables that are read in columns or filtered."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (survives executor loss) and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
