"""A training corpus from ``documents``: quality, near copies, repeated strings, benchmark
leaks, piece ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before kept.
All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm import decontamination, near, pieces, quality, repeats
from sourceloom.llm.registry import table
from sourceloom.llm.shared import kept

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# The stages' order, and a stage that SQL cannot express: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on them and ``labels``, does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(docs, model) >= quality.THRESHOLD)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest id."""
    stays = near.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(stays, F.col("doc_id").cast("bigint").eqNullSafe(F.col("kept_id")), "left_semi")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without bytes that a 100-byte string covers which also starts earlier.

    A character that lost some of its bytes goes whole; ``n_chars`` is counted anew. A text
    of which nothing is left stays as an empty one.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = repeats.without_repeats(docs, carry=others, as_text=True)
    cleaned = rows.select("row.*", F.col("rest").alias("text"))
    if "n_chars" in others:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*(f"`{c}`" for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word that belongs to a window of a benchmark item."""
    hits = decontamination.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns, unnamed=True)
    return hits.where(F.size("runs") == 0).select("row.*").select(*(f"`{c}`" for c in docs.columns))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return pieces.encoded(docs, PIECE_MODEL).select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread by the next."""
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        rows = kept(stage(spark, rows, sf_dir))
    return rows
