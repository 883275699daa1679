"""Similarity and chunks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.functions.vectors import cosine
from sourceloom.operators.chunking import chunk_documents
from sourceloom.operators.similarity import search_similar, search_similar_batch
from sourceloom.operators.skew import spread
from sourceloom.plans import adapters as t
from sourceloom.plans.registry import query

CHUNK_BYTES = 400
VECTORS = "select vec_id as id, label, embedding::double[] as v from embeddings"


def _vectors(spark, sf):
    return t.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


def _first(spark, sf):
    """The query vector, as a scalar subquery."""
    return _vectors(spark, sf).where("id = 0").select("embedding").scalar()


@query("f1_cosine", f"""
with v as ({VECTORS}), q as (select v as qv from v where id = 0)
select id, round(list_cosine_similarity(v, qv), 6) as similarity from v, q""")
def cosine_to_first(spark, sf):
    both = _vectors(spark, sf).withColumn("first", _first(spark, sf))
    return both.select("id", F.round(cosine("embedding", "first"), 6).alias("similarity"))


@query("f2_top_k", f"""
with v as ({VECTORS}), q as (select v as qv from v where id = 0)
select id, round(list_cosine_similarity(v, qv), 6) as similarity from v, q
order by list_cosine_similarity(v, qv) desc, id limit 10""")
def top_k(spark, sf):
    return search_similar(_vectors(spark, sf), _first(spark, sf), 10).select(
        "id", F.round("similarity", 6).alias("similarity")
    )


@query("f2_top_k_batch", f"""
with v as ({VECTORS}), q as (select id as query_id, v as qv from v where label = 0),
s as (select query_id, id, round(list_cosine_similarity(v, qv), 12) as s from v, q),
r as (select *, row_number() over (partition by query_id order by s desc, id) as rank from s)
select query_id, id, round(s, 6) as similarity, rank from r where rank <= 10""")
def top_k_batch(spark, sf):
    queries = _vectors(spark, sf).where("label = 0").withColumnRenamed("id", "query_id")
    return search_similar_batch(_vectors(spark, sf), queries, 10).select(
        "query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank")
    )


@query("g1_chunks", f"""
with recursive d as (select doc_id, string_split(text, chr(10)) as lines from documents),
step(doc_id, line, start_line, size) as (
  select doc_id, 1, 1, strlen(lines[1]) + 1 from d
  union all
  select s.doc_id, s.line + 1, case when s.size >= {CHUNK_BYTES} then s.line + 1 else s.start_line end,
         case when s.size >= {CHUNK_BYTES} then 0 else s.size end + strlen(d.lines[s.line + 1]) + 1
  from step s join d on d.doc_id = s.doc_id where s.line < len(d.lines)),
c as (select doc_id, start_line, max(line) as end_line from step group by 1, 2)
select doc_id, array_to_string(lines[start_line:end_line], chr(10)) || chr(10) as content,
       start_line, end_line
from c join d using (doc_id)""")
def chunks(spark, sf):
    docs = spread(t.table(spark, sf, "documents").select("doc_id", "text"), t.cores(spark))
    return chunk_documents(docs, "doc_id", "text", CHUNK_BYTES)
