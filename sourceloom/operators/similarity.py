"""Nearest documents by cosine similarity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.functions.vectors import cosine

# Vectors that one task holds at a time: so many rows or numbers of documents and of queries,
# and so many of their scores.
MAX_DOC_ROWS, MAX_DOC_VALUES = 20_000, 1 << 20
MAX_QUERY_ROWS, MAX_QUERY_VALUES = 10_000, 1 << 19
TILE = 1 << 21


def search_similar(docs: DataFrame, vector: Sequence[float] | Column, limit: int) -> DataFrame:
    """The ``limit`` nearest rows of ``id, embedding`` with ``similarity``, best first.

    ``vector`` may be a column, such as a scalar subquery.

    Rows without an embedding are left out; other lengths stay with 0. Spark keeps
    ``limit`` rows per task (TakeOrderedAndProject), never a full sort.
    """
    query = vector if isinstance(vector, Column) else F.lit([float(x) for x in vector])
    # A column of its own: subqueries may not stand inside array functions.
    held = docs.where(F.size("embedding") > 0).withColumn("__query", query.cast("array<double>"))
    scored = held.withColumn("similarity", cosine("embedding", "__query")).drop("__query")
    return scored.orderBy(F.desc("similarity"), "id").limit(limit)


def search_similar_batch(docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """``query_id, id, similarity, rank`` of the nearest documents for each query row
    (``query_id, embedding``).

    Documents and queries are dealt to blocks of bounded size, and every block of the ones
    meets every block of the others in a group. It is scored in tiles by matrix products and
    passes on its best ``limit`` per query; only those are ranked. Pairs are never
    materialised, and no vector comes to the driver.
    """
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = asked.where(F.col("v").isNotNull())
    held = docs.where(F.size("embedding") > 0).select("id", "embedding")
    doc_blocks, query_blocks = _blocks(held, "embedding", MAX_DOC_ROWS, MAX_DOC_VALUES), _blocks(asked, "v", MAX_QUERY_ROWS, MAX_QUERY_VALUES)
    schema = T.StructType([
        T.StructField("query_id", T.LongType()), T.StructField("id", docs.schema["id"].dataType),
        T.StructField("similarity", T.DoubleType()),
    ])
    pairs = _dealt(held, "d", doc_blocks, "q", query_blocks).cogroup(_dealt(asked, "q", query_blocks, "d", doc_blocks))
    found = pairs.applyInPandas(lambda d, q: _best(d, q, limit), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _blocks(rows: DataFrame, vector: str, max_rows: int, max_values: int) -> int:
    n, values = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(vector)), F.lit(0))).first()
    return max(1, -(-n // max_rows), -(-values // max_values))


def _dealt(rows: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> GroupedData:
    """Rows in one of their blocks each, once for every block of the others."""
    block = F.pmod(F.monotonically_increasing_id(), F.lit(own_blocks)).cast("int").alias(own)
    every = F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(other)
    return rows.select("*", block).select("*", every).groupBy("d", "q")


def _best(docs: pd.DataFrame, queries: pd.DataFrame, limit: int) -> pd.DataFrame:
    """The nearest of some documents for some queries."""
    ids, names = docs["id"].to_numpy(), queries["query_id"].to_numpy()
    lengths = docs["embedding"].map(len).to_numpy(dtype=np.int64)
    units = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        units[n] = at, _unit(np.stack(docs["embedding"].iloc[at].to_list()).astype(np.float64))
    step, found = max(1, TILE // max(1, len(docs))), []
    for a in range(0, len(queries) if len(docs) else 0, step):
        part = queries["v"].iloc[a : a + step]
        own = part.map(len).to_numpy(dtype=np.int64)
        scores = np.zeros((len(part), len(docs)))
        for n in np.unique(own).tolist():
            if n in units:
                rows, (at, unit) = np.flatnonzero(own == n), units[n]
                asked = _unit(np.stack(part.iloc[rows].to_list()).astype(np.float64))
                scores[np.ix_(rows, at)] = asked @ unit.T
        scores = np.round(scores, 12)  # equal vectors tie, whatever the block
        found.append(_top(names[a : a + step], ids, scores, limit))
    none = pd.DataFrame({"query_id": names[:0], "id": ids[:0], "similarity": np.empty(0)})
    return pd.concat(found, ignore_index=True) if found else none


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one; zero rows stay zero, so they score 0."""
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _top(names: np.ndarray, ids: np.ndarray, scores: np.ndarray, limit: int) -> pd.DataFrame:
    """Best rows per query."""
    if 0 < limit < scores.shape[1]:
        cut = np.partition(scores, -limit, axis=1)[:, [-limit]]
        rows, cols = np.nonzero(scores >= cut)  # keeps every tie at the cut
    else:
        rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
    found = pd.DataFrame({"query_id": names[rows], "id": ids[cols], "similarity": scores[rows, cols]})
    ordered = found.sort_values(["query_id", "similarity", "id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(limit)
