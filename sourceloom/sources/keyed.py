"""Tables saved batch by batch: only what a batch touches is read and written.

A keyed table is a folder of Parquet files bucketed by one column of its key. The partition
column ``bucket_of_<n>`` holds the number of Spark's bucket, so a partition is a bucket: a
save replaces the touched ones (dynamic partition overwrite) and leaves all others alone;
a lookup by the column opens one bucket; and joins and aggregates on the column need no
exchange. References are kept twice, by source and by target, so both directions do.

A save reads the touched buckets, writes their new rows beside the table, and Spark then puts
the finished partitions in place, one after the other. A lost executor costs a retry. If the
driver dies while they are put in place, the same batch saved again completes the work (it
is last write wins by key); a save must not run at the same time as another of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.schemas import DOCUMENT, REFERENCE
from sourceloom.sources.store import DOCUMENT_KEY, REFERENCE_KEY

PREFIX = "bucket_of_"
# Buckets of a new table: about one per 32 MB that it shall hold is a good choice (``pieces``),
# since a join or aggregate by bucket sorts a bucket's rows in one task.
BUCKETS = 64
BUCKET_BYTES = 32 << 20
# A bucket with more bytes is read without bucketing: Spark then splits it among tasks.
LARGE_BUCKET = 128 << 20


@dataclass(frozen=True)
class KeyedTable:
    path: str
    schema: T.StructType
    key: tuple[str, ...]
    by: str
    buckets: int = BUCKETS  # for a new table; one that exists keeps its own

    @property
    def name(self) -> str:
        """In the session's catalog."""
        return "sourceloom_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]


def documents(path: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(f"{path}/documents", DOCUMENT, tuple(DOCUMENT_KEY), "id", buckets)


def references(path: str, buckets: int = BUCKETS) -> tuple[KeyedTable, KeyedTable]:
    """The two tables of references: by source and by target."""
    key = tuple(REFERENCE_KEY)
    return (
        KeyedTable(f"{path}/references_by_source", REFERENCE, key, "source_id", buckets),
        KeyedTable(f"{path}/references_by_target", REFERENCE, key, "target_id", buckets),
    )


def bucket_of(value: Column, buckets: int) -> Column:
    """Spark's bucket number."""
    return F.pmod(F.hash(value), F.lit(buckets)).cast("int")


def pieces(rows: DataFrame, least: int) -> int:
    """Buckets, or tasks, for what ``rows`` is made from: one per ``BUCKET_BYTES`` of the files
    and local rows that are read, as far as Spark knows their sizes; no job is run."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(least, -(-sum(s for s in sizes if s < 1 << 60) // BUCKET_BYTES))  # unknown ones are huge


def _files(spark: SparkSession, table: KeyedTable, pattern: str) -> list:
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(table.path)
    return list(folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(folder, pattern)) or [])


def _column(spark: SparkSession, table: KeyedTable) -> str:
    """The partition column: of the folder if it holds rows, else the one it will get."""
    found = {f.getPath().getName().split("=")[0] for f in _files(spark, table, f"{PREFIX}*=*")}
    if len(found) > 1:
        raise ValueError(f"{table.path} has several numbers of buckets: {sorted(found)}")
    return found.pop() if found else f"{PREFIX}{table.buckets}"


def opened(spark: SparkSession, table: KeyedTable) -> DataFrame:
    """The table's rows with their partition column. Registers the folder in the session's
    catalog; a folder that does not exist yet is an empty table."""
    column = _column(spark, table)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    known = spark.catalog.tableExists(table.name)
    if known and column not in spark.table(table.name).columns:
        spark.sql(f"drop table {table.name}")  # the entry; files stay where they are
    spark.sql(
        f"create table if not exists {table.name} ({fields}, {column} int) using parquet partitioned by ({column}) "
        f"clustered by (`{table.by}`) sorted by (`{table.by}`) into {column.removeprefix(PREFIX)} buckets location '{table.path}'"
    )
    if _files(spark, table, f"{PREFIX}*=*"):
        spark.catalog.recoverPartitions(table.name)
    spark.catalog.refreshTable(table.name)
    return spark.table(table.name)


def largest_bucket(spark: SparkSession, table: KeyedTable) -> int:
    """Bytes of the largest bucket, from the file listing."""
    sizes: dict[str, int] = {}
    for f in _files(spark, table, f"{PREFIX}*=*/*"):
        bucket = f.getPath().getParent().getName()
        sizes[bucket] = sizes.get(bucket, 0) + f.getLen()
    return max(sizes.values(), default=0)


def rows(spark: SparkSession, table: KeyedTable, large: int = LARGE_BUCKET) -> DataFrame:
    """All rows, bucketed by ``table.by`` for joins and aggregates without an exchange. If a
    key is so frequent that its bucket has over ``large`` bytes, as plain files instead."""
    found = opened(spark, table)
    column = found.columns[-1]
    if largest_bucket(spark, table) > large:
        found = spark.read.schema(found.schema).option("basePath", table.path).parquet(table.path)
    return found.drop(column)


def lookup(spark: SparkSession, table: KeyedTable, *values: str) -> DataFrame:
    """Rows with one of these values in ``table.by``: a bucket is read for each."""
    found = opened(spark, table)
    column = found.columns[-1]
    kind, n = table.schema[table.by].dataType, int(column.removeprefix(PREFIX))
    there = [bucket_of(F.lit(v).cast(kind), n) for v in values]
    return found.where(F.col(column).isin(*there) & F.col(table.by).isin(*values)).drop(column)


@contextmanager
def _touched_only(spark: SparkSession, rows: DataFrame) -> Iterator[None]:
    """Writes replace the partitions they have rows for. Rows are dealt to as many tasks as they
    need, so that a task sorts no more of a larger batch."""
    partitions = "spark.sql.shuffle.partitions"
    settings = {"spark.sql.sources.partitionOverwriteMode": "dynamic", partitions: str(pieces(rows, int(spark.conf.get(partitions))))}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def save(batch: DataFrame, table: KeyedTable, seq: str = "seq") -> list[int]:
    """Put a batch (the table's columns and ``seq``) into the table: per key its last row, by
    ``seq``, takes the place of the row that was there. Returns the numbers of the buckets
    written; an empty batch writes none. Null is a key like any other."""
    spark = batch.sparkSession
    now = opened(spark, table)
    column = now.columns[-1]
    bucket = bucket_of(F.col(f"`{table.by}`"), int(column.removeprefix(PREFIX)))
    touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # numbers below the count of buckets
    if not touched:
        return []
    # Rows that are there and those of the batch meet in one shuffle by key, keys once in a row;
    # rows of one key collapse before it.
    held = now.where(F.col(column).isin(touched)).select(*(F.col(f"`{f.name}`") for f in table.schema), F.lit(False).alias("__new"), F.lit(None).cast(batch.schema[seq].dataType).alias("__seq"))
    come = batch.select(*(F.col(f"`{f.name}`") for f in table.schema), F.lit(True).alias("__new"), F.col(f"`{seq}`").alias("__seq"))
    key, rest = ([F.col(f"`{f.name}`") for f in table.schema if (f.name in table.key) == is_key] for is_key in (True, False))
    grouped = held.unionByName(come).groupBy(*key)
    merged = grouped.agg(F.max_by(F.struct(*rest), F.struct("__new", "__seq")).alias("__row")).select(*key, "__row.*") if rest else grouped.agg(F.lit(1)).select(*key)
    merged = merged.withColumn(column, bucket).select(*(f"`{c}`" for c in now.columns))
    with _touched_only(spark, merged):
        # A bucket is one task's, unless it is large.
        merged.hint("rebalance", F.col(column)).write.mode("overwrite").insertInto(table.name)
    spark.catalog.refreshTable(table.name)
    return touched


def save_documents(batch: DataFrame, path: str, seq: str = "seq", buckets: int = BUCKETS) -> list[int]:
    return save(batch, documents(path, buckets), seq)


def save_references(batch: DataFrame, path: str, seq: str = "seq", buckets: int = BUCKETS) -> tuple[list[int], list[int]]:
    """Both directions. The batch is evaluated for each; a save that died between the two is
    completed by saving the batch again."""
    by_source, by_target = references(path, buckets)
    return save(batch, by_source, seq), save(batch, by_target, seq)


def get_document(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    return lookup(spark, documents(path), doc_id)


def out_edges(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    return lookup(spark, references(path)[0], source_id).orderBy("target_id", "type")


def in_edges(spark: SparkSession, path: str, target_id: str) -> DataFrame:
    return lookup(spark, references(path)[1], target_id).orderBy("source_id", "type")
