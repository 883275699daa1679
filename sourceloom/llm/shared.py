"""Settings, folders and bounded collects that several operators use."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set only in local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sourceloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write rows to the shared folder and read them back: lineage ends here, and lost
    executors take nothing with them."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/sourceloom-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *rows: DataFrame) -> None:
    """Delete tables that ``kept`` wrote and nothing reads any more. The shuffle files of finished
    steps go with the driver's next garbage, which is collected here."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for r in rows for f in r.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    for _ in range(2):  # the driver's Python lets go first
        gc.collect()
        jvm.System.gc()
        time.sleep(0.3)
