"""Lookups in the document and reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.paths import base_name


def get_document(docs: DataFrame, doc_id: str) -> DataFrame:
    """The document with this id; no row if there is none."""
    return docs.where(F.col("id") == doc_id)


def list_documents(docs: DataFrame, doc_type: str) -> DataFrame:
    """Documents of one type by id. Range-sorted by Spark, not in one task."""
    return docs.where(F.col("type") == doc_type).orderBy("id")


def out_edges(refs: DataFrame, source_id: str) -> DataFrame:
    return refs.where(F.col("source_id") == source_id).orderBy("target_id", "type")


def in_edges(refs: DataFrame, target_id: str) -> DataFrame:
    return refs.where(F.col("target_id") == target_id).orderBy("source_id", "type")


def search(rows: DataFrame, query: str) -> DataFrame:
    """Rows with the text in ``title`` or ``description``, in any letter case."""
    wanted = F.lower(F.lit(query))
    return rows.where(
        F.contains(F.lower("title"), wanted) | F.contains(F.lower("description"), wanted)
    )


def search_rows(docs: DataFrame) -> DataFrame:
    """What the search page shows per document."""
    return docs.select("path", base_name("path").alias("title"), F.col("content").alias("description"))


def find_files(files: DataFrame, paths: DataFrame) -> DataFrame:
    """File rows for wanted paths, once per wanted row."""
    return paths.join(files, ["path"], "inner")


def edge_counts(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Per document: how many edges leave it and how many reach it."""
    ends = refs.select(F.explode(F.array(
        F.struct(F.col("source_id").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("target_id").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")),
    )).alias("end")).select("end.*")
    degrees = ends.groupBy("id").agg(F.sum("out").alias("n_deps"), F.sum("in").alias("n_used_by"))
    return docs.join(degrees, "id", "left").select(
        *docs.columns,
        F.coalesce("n_deps", F.lit(0)).alias("n_deps"),
        F.coalesce("n_used_by", F.lit(0)).alias("n_used_by"),
    )


def stored_edge_counts(docs: DataFrame, by_source: DataFrame, by_target: DataFrame) -> DataFrame:
    """As ``edge_counts`` of references stored by source and by target (``sources.keyed``):
    edges are counted where they lie, and nothing is dealt if ``docs`` is stored alike."""
    out = by_source.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n_deps"))
    into = by_target.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n_used_by"))
    return docs.join(out, "id", "left").join(into, "id", "left").select(
        *docs.columns, F.coalesce("n_deps", F.lit(0)).alias("n_deps"), F.coalesce("n_used_by", F.lit(0)).alias("n_used_by")
    )


def dependency_rows(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per edge of a known document; ``target_path`` is null if unresolved."""
    targets = docs.select(F.col("id").alias("target_id"), F.col("path").alias("target_path"))
    sources = docs.select(F.col("id").alias("source_id"), F.col("path").alias("source_path"))
    resolved = refs.join(targets, ["target_id"], "left")
    return resolved.join(sources, ["source_id"], "inner").select(
        "source_id", "source_path", "target_id", "target_path", "type"
    )
