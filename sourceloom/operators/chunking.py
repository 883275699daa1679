"""Documents cut into line-aligned chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.chunks import chunk_contents, line_count, prefix_sums


def chunk_documents(docs: DataFrame, key: str, text: str, max_bytes: int) -> DataFrame:
    """``key, content, start_line, end_line`` per chunk. Map-only: no shuffle.

    The text is cut once; line numbers are running sums over the cut pieces.
    """
    cut = docs.select(key, chunk_contents(text, max_bytes).alias("__parts"))
    counted = cut.withColumn("__lines", F.transform("__parts", line_count))
    zipped = F.arrays_zip("__parts", "__lines", prefix_sums(F.col("__lines")).alias("__ends"))
    return counted.select(key, F.explode(zipped).alias("c")).select(
        key,
        F.col("c.__parts").alias("content"),
        (F.col("c.__ends") - F.col("c.__lines") + 1).alias("start_line"),
        F.col("c.__ends").alias("end_line"),
    )
