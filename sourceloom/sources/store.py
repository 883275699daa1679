"""Documents and references as Parquet tables with upserts.

A table is a folder of complete versions ``v=<n>``. A write never touches the version
being read: it makes the next one, which counts from the moment Spark has put its
``_SUCCESS`` marker there. A job that dies leaves an unmarked folder nobody reads, and
running it again writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_KEY = ["id"]
REFERENCE_KEY = ["source_id", "target_id", "type"]


def latest(batch: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Last write per key. Writes of a hot key collapse before the shuffle."""
    newest = F.max_by(F.struct(*batch.columns), F.col(seq)).alias("__row")
    return batch.groupBy(*key).agg(newest).select("__row.*")


def upsert(current: DataFrame, batch: DataFrame, key: list[str], seq: str) -> DataFrame:
    """``current`` (one row per key) with the batch's last writes in place of its own.

    ``current`` keeps its rows by an anti join on the batch keys: with a small batch
    Spark broadcasts the keys and the big table is neither shuffled nor sorted.
    """
    newest = latest(batch, key, seq).drop(seq)
    untouched = current.join(batch.select(*key).distinct(), key, "left_anti")
    return untouched.unionByName(newest)


def upsert_documents(current: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    return upsert(current, batch, DOCUMENT_KEY, seq)


def upsert_references(current: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    return upsert(current, batch, REFERENCE_KEY, seq)


def current_version(spark: SparkSession, path: str) -> int | None:
    """Highest finished version of a table, None if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(hadoop.Path(folder, "v=*/_SUCCESS")) or []
    return max((int(s.getPath().getParent().getName()[2:]) for s in done), default=None)


def write_version(rows: DataFrame, path: str, partition_by: str | None = None) -> int:
    """Write the next version. A second writer that chose the same one fails: it finds the
    folder there, finished or not. An unfinished one of a dead job counts as taken too."""
    version = highest_version(rows.sparkSession, path) + 1
    writer = rows.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{path}/v={version}")
    return version


def highest_version(spark: SparkSession, path: str) -> int:
    """Highest version of a table, finished or not; -1 if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(folder, "v=*")) or []
    return max((int(s.getPath().getName()[2:]) for s in found), default=-1)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The last finished version. With a schema, one without a single row can be read too."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no finished version below {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/v={version}")


def save(
    batch: DataFrame, path: str, key: list[str], seq: str = "seq", partition_by: str | None = None
) -> int:
    """Write the next version with ``batch`` applied; returns its number."""
    spark = batch.sparkSession
    if current_version(spark, path) is None:
        rows = latest(batch, key, seq).drop(seq)
    else:
        rows = upsert(read_table(spark, path), batch, key, seq)
    return write_version(rows, path, partition_by)


def save_documents(batch: DataFrame, path: str, seq: str = "seq") -> int:
    """Partitioned by ``type``, so listing one type reads only its files."""
    return save(batch, path, DOCUMENT_KEY, seq, partition_by="type")


def save_references(batch: DataFrame, path: str, seq: str = "seq") -> int:
    return save(batch, path, REFERENCE_KEY, seq)
