"""Whole runs: from a tree to stored documents, references and pages.

Each step is a Spark job over a table in ``out``. Model answers are written before they
are used, so a lost executor or a second run does not ask the model again for what it has
answered: a run adds only the answers that are missing. Every table has versions, pages
too, so a run may be repeated on the same folder. Failed calls are returned, not lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.operators import analysis, edges, pages
from sourceloom.operators.enrich import Retry, Throttle, enrich, missing, prompt_key
from sourceloom.operators.skew import with_rank
from sourceloom.schemas import DOCUMENT, REFERENCE
from sourceloom.session import new_folder
from sourceloom.sources import keyed, store
from sourceloom.sources.tree import DEFAULT_EXTENSIONS, classify_files, split_rejects, with_extensions

ANSWERS = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "response", "error", "prompt_id")])
Client = Callable[[], Callable[[str | None, str], str]]


def answers(
    prompts: DataFrame, make_client: Client, path: str,
    retry: Retry = Retry(), throttle: Throttle | None = None, parallelism: int | None = None, in_flight: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Good answers ``path, response`` for the prompts, and failed calls ``path, error``.

    Both are kept as a keyed table at ``path``, of which a run writes what it touches. An
    answer counts for its prompt only: if the prompt's text changed, the model is asked again,
    and several prompts of one path have an answer each. Repeated prompts are asked once.
    """
    spark = prompts.sparkSession
    table = keyed.KeyedTable(path, ANSWERS, ("path", "prompt_id"), "path")
    asked = prompt_key(prompts).dropDuplicates(["path", "prompt_id"])
    left = missing(asked, keyed.rows(spark, table).where("error is null"))
    fresh = enrich(left, make_client, retry, throttle, parallelism, in_flight, ["prompt_id"]).select(*ANSWERS.fieldNames())
    # Written once as they come, so that a save that is tried again asks nothing twice.
    folder = new_folder(spark, "answers")
    fresh.write.parquet(folder)
    keyed.save(spark.read.schema(ANSWERS).parquet(folder).withColumn("seq", F.lit(0)), table)
    stored = keyed.rows(spark, table).join(asked.select("path", "prompt_id"), ["path", "prompt_id"], "left_semi")
    return stored.where("error is null").select("path", "response"), stored.where("error is not null").select("path", "error")


def _numbered(rows: DataFrame) -> DataFrame:
    """One write per key in a run, so any constant order serves."""
    return rows.withColumn("seq", F.lit(0))


def document_tree(
    files: DataFrame, make_client: Client, out: str, at: str,
    extensions: Iterable[str] = DEFAULT_EXTENSIONS, **calls,
) -> DataFrame:
    """Documentation text per file: documents stored, index and component pages written.

    Returns ``path, reason`` of what has no page: rejected files and failed calls.
    """
    spark = files.sparkSession
    accepted, rejected = split_rejects(with_extensions(files, extensions))
    prompts = analysis.with_documentation_prompt(accepted).select("path", "prompt")
    given, failed = answers(prompts, make_client, f"{out}/answers", **calls)
    docs = analysis.response_documents(given, at)
    store.save_documents(_numbered(docs), f"{out}/documents")
    stored = store.read_table(spark, f"{out}/documents", DOCUMENT)
    no_refs = stored.where(F.lit(False)).select("path", F.lit(0).alias("pos"), F.col("id").alias("target"))
    pages.write_pages(pages.documentation_pages(stored, no_refs, at), f"{out}/pages")
    return rejected.select("path", "reason").unionByName(failed.withColumnRenamed("error", "reason"))


def analyse_tree(
    files: DataFrame, make_client: Client, out: str, at: str, **calls
) -> tuple[DataFrame, DataFrame]:
    """Structured analysis per file: documents, references and pages written.

    Returns the answers that could not be parsed, and the failed calls ``path, error``.
    """
    spark = files.sparkSession
    prompts = analysis.with_analysis_prompt(classify_files(files))
    given, failed = answers(prompts.select("path", "system_prompt", "prompt"), make_client, f"{out}/answers", **calls)
    good, bad = analysis.parse_analysis(given)
    store.save_documents(_numbered(analysis.analysis_documents(good, at)), f"{out}/documents")
    docs = store.read_table(spark, f"{out}/documents", DOCUMENT)
    known = edges.known_paths(files.select("path"))
    found = edges.document_edges(docs, known).select(
        "source_id", "target_id", "type", F.lit(at).cast("timestamp").alias("created_at")
    )
    store.save_references(_numbered(found), f"{out}/references")
    refs = store.read_table(spark, f"{out}/references", REFERENCE)
    pages.write_pages(pages.documentation_pages(docs, reference_rows(docs, refs), at), f"{out}/pages")
    return bad, failed


def reference_rows(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Targets of each document's edges in key order, as ``path, pos, target``."""
    placed = refs.join(docs.select(F.col("id").alias("source_id"), "path"), "source_id")
    ranked = with_rank(placed.select("path", "target_id", "type"), ["path"], ["target_id", "type"], "pos")
    return ranked.select("path", "pos", F.col("target_id").alias("target"))


def write_wiki(docs: DataFrame, refs: DataFrame, out: str, at: str) -> None:
    """Wiki pages of stored documents and references."""
    pages.write_pages(pages.wiki_pages(docs, refs, at), out)
