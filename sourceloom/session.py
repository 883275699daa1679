"""Session settings the operators are designed for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a running session can still take.
TUNING = {
    # Text parts are collected per group. Sorting first keeps one group in memory at a
    # time; the hash map would hold many, then sort after all once it has seen 128.
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    **TUNING,
}


def tune(spark: SparkSession) -> None:
    for key, value in TUNING.items():
        spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, set as Spark's checkpoint
    folder. A session of one process, as in tests, gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for tests and bench; a cluster brings its own master, memory and sizes."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sourceloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
