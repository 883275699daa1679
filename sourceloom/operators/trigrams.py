"""Text search by an inverted index of trigrams.

The rows are stored in blocks; a posting is a trigram, a block and the rows of the block that
hold it, so a trigram that all rows hold has a list per block and no group is larger than
a block. A search reads the lists of the query's trigrams (one bucket each), intersects them
block by block, and reads the texts of blocks with candidates only (Spark prunes the other
partitions); the candidates are then searched as a scan would search them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.operators.lookups import search
from sourceloom.sources import keyed

POSTING = T.StructType([
    T.StructField("trigram", T.StringType()), T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(T.IntegerType())),
])


@dataclass(frozen=True)
class TextIndex:
    path: str
    block_rows: int = 4096
    buckets: int = keyed.BUCKETS

    @property
    def texts(self) -> str:
        return f"{self.path}/texts"

    @property
    def postings(self) -> keyed.KeyedTable:
        return keyed.KeyedTable(f"{self.path}/postings", POSTING, ("trigram", "block"), "trigram", self.buckets)


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of a text, lower-cased; in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def build(rows: DataFrame, index: TextIndex) -> None:
    """Store ``rows`` (``title``, ``description`` and others) and their postings in a new folder.

    Null texts hold nothing. Repeated rows stay apart. A text of any length is read once for
    its trigrams, of which it has a posting each. A folder that holds an index is refused.
    """
    spark = rows.sparkSession
    row = F.monotonically_increasing_id()
    numbered = rows.withColumn("__row", row)  # numbers are kept with the rows, so that later jobs agree
    block = F.call_function("div", F.col("__row"), F.lit(index.block_rows))
    numbered.limit(0).coalesce(1).write.parquet(f"{index.path}/columns")  # for an index without a row
    numbered.withColumn("__block", block).write.partitionBy("__block").parquet(index.texts)
    stored = _texts(spark, index)
    place = F.pmod("__row", F.lit(index.block_rows)).cast("int").alias("place")
    held = F.concat(*(F.coalesce(trigrams(F.col(c)), F.array().cast("array<string>")) for c in ("title", "description")))
    found = stored.select("__block", place, F.explode(F.array_distinct(held)).alias("trigram"))
    lists = found.groupBy("trigram", F.col("__block").alias("block")).agg(F.array_sort(F.collect_list("place")).alias("rows"))
    keyed.save(lists.withColumn("seq", F.lit(0)), index.postings)


def _texts(spark: SparkSession, index: TextIndex) -> DataFrame:
    schema = spark.read.parquet(f"{index.path}/columns").schema
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("__block", T.LongType())])).parquet(index.texts)


def candidates(spark: SparkSession, index: TextIndex, query: str) -> DataFrame:
    """``__block, __row`` of the rows that hold all trigrams of a query of three characters and more."""
    # One literal row, made by the optimizer: no job.
    wanted = sorted(spark.sql("select 1").select(trigrams(F.lit(query)).alias("t")).first().t)
    lists = keyed.lookup(spark, index.postings, *wanted)
    together = lists.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.collect_list("rows").alias("lists")).where(F.col("n") == len(wanted))
    common = F.aggregate(F.slice("lists", 2, max(len(wanted), 1)), F.element_at("lists", 1), F.array_intersect)
    found = together.select(F.col("block").alias("__block"), F.explode(common).alias("place"))
    return found.select("__block", (F.col("__block") * index.block_rows + F.col("place")).alias("__row"))


def indexed_search(spark: SparkSession, index: TextIndex, query: str) -> DataFrame:
    """As ``lookups.search`` over the rows of the index. A query of fewer than three characters
    has no trigram and is answered by a scan."""
    texts = _texts(spark, index)
    own = [c for c in texts.columns if c not in ("__block", "__row")]
    if spark.sql("select 1").select(F.size(trigrams(F.lit(query))).alias("n")).first().n:
        texts = texts.join(candidates(spark, index, query), ["__block", "__row"], "left_semi")
    return search(texts, query).select(*(f"`{c}`" for c in own))
