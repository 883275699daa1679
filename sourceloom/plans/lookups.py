"""Lookups over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.operators import lookups as op
from sourceloom.operators import trigrams
from sourceloom.operators.edges import normalised_edges
from sourceloom.operators.skew import text_parts
from sourceloom.plans import adapters as t
from sourceloom.plans.registry import query
from sourceloom.session import new_folder
from sourceloom.sources import keyed
from sourceloom.sources.tree import split_rejects

KEYED = f"""
select distinct source_id, target_id, {t.sql_relation_type('raw_type')} as type from e"""
SEARCHED = "tion of"


@query("b1_get_document", f"with d as ({t.DOCS}) select id, path, type, content from d where id = 'p7'")
def get_document(spark, sf):
    return op.get_document(t.documents(spark, sf), "p7")


@query("b2_list_documents", f"with d as ({t.DOCS}) select id, path, content from d where type = 'module'")
def list_documents(spark, sf):
    return op.list_documents(t.documents(spark, sf), "module").select("id", "path", "content")


@query("b3_out_edges", f"""
with e as ({t.EDGES}), k as ({KEYED})
select source_id, target_id, type from k where source_id = 'p7'""")
def out_edges(spark, sf):
    return op.out_edges(normalised_edges(t.edges(spark, sf)), "p7").drop("ref_key")


@query("b4_in_edges", f"""
with e as ({t.EDGES}), k as ({KEYED})
select source_id, target_id, type from k where target_id = 's3'""")
def in_edges(spark, sf):
    return op.in_edges(normalised_edges(t.edges(spark, sf)), "s3").drop("ref_key")


@query("b3_stored_out_edges", f"""
with e as ({t.EDGES}), k as ({KEYED})
select source_id, target_id, type from k where source_id = 'p7'""")
def stored_out_edges(spark, sf):
    by_source, _ = t.saved_references(spark, sf)
    return keyed.lookup(spark, by_source, "p7").drop("last_seen")


@query("b4_stored_in_edges", f"""
with e as ({t.EDGES}), k as ({KEYED})
select source_id, target_id, type from k where target_id = 's3'""")
def stored_in_edges(spark, sf):
    _, by_target = t.saved_references(spark, sf)
    return keyed.lookup(spark, by_target, "s3").drop("last_seen")


@query("b5_stored_edge_counts", f"""
with e as ({t.EDGES}), k as ({KEYED}), d as ({t.DOCS}),
o as (select source_id, count(*) as n from k group by 1),
i as (select target_id, count(*) as n from k group by 1)
select d.id, d.path, coalesce(o.n, 0) as n_deps, coalesce(i.n, 0) as n_used_by
from d left join o on o.source_id = d.id left join i on i.target_id = d.id""")
def stored_edge_counts(spark, sf):
    by_source, by_target = t.saved_references(spark, sf)
    docs = keyed.rows(spark, t.saved_documents(spark, sf)).select("id", "path")
    return op.stored_edge_counts(docs, keyed.rows(spark, by_source), keyed.rows(spark, by_target))


@query("b5_edge_counts", f"""
with e as ({t.EDGES}), k as ({KEYED}), d as ({t.DOCS}),
o as (select source_id, count(*) as n from k group by 1),
i as (select target_id, count(*) as n from k group by 1)
select d.id, d.path, coalesce(o.n, 0) as n_deps, coalesce(i.n, 0) as n_used_by
from d left join o on o.source_id = d.id left join i on i.target_id = d.id""")
def edge_counts(spark, sf):
    refs = normalised_edges(t.edges(spark, sf))
    return op.edge_counts(t.documents(spark, sf).select("id", "path"), refs)


@query("b5_dependency_lists", f"""
with e as ({t.EDGES}), k as ({KEYED}), d as ({t.DOCS}),
r as (
  select k.source_id, a.path as source_path, k.target_id, k.type,
         k.type || ' ' || coalesce(b.path, '') || ' -> ' || k.target_id as line
  from k join d a on a.id = k.source_id left join d b on b.id = k.target_id)
{t.sql_parts('source_id, source_path', 'line', 'target_id, type', 'r', 'deps', 'chr(10)')}""")
def dependency_lists(spark, sf):
    refs = normalised_edges(t.edges(spark, sf))
    rows = op.dependency_rows(t.documents(spark, sf), refs)
    line = F.concat("type", F.lit(" "), F.coalesce("target_path", F.lit("")), F.lit(" -> "), "target_id")
    return text_parts(
        rows.withColumn("line", line), ["source_id"], ["target_id", "type"],
        out="deps", sep="\n", keep=("source_path",), sized=t.raw_edges(spark, sf),
    )


@query("b6_search", f"""
select source as title, doc_id, text as description from documents
where contains(lower(source), '{SEARCHED}') or contains(lower(text), '{SEARCHED}')""")
def search(spark, sf):
    rows = t.table(spark, sf, "documents").select(
        F.col("source").alias("title"), "doc_id", F.col("text").alias("description")
    )
    return op.search(rows, SEARCHED.upper())


@query("b6_indexed_search", f"""
select source as title, doc_id, text as description from documents
where contains(lower(source), '{SEARCHED}') or contains(lower(text), '{SEARCHED}')""")
def indexed_search(spark, sf):
    """As b6_search, by an index of trigrams over all texts."""
    rows = t.table(spark, sf, "documents").select(F.col("source").alias("title"), "doc_id", F.col("text").alias("description"))
    index = trigrams.TextIndex(new_folder(spark, "index"), 256, 8)
    trigrams.build(rows, index)
    return trigrams.indexed_search(spark, index, SEARCHED.upper())


@query("b7_find_files", f"""
with f as ({t.FILES})
select l.doc_id, f.path, l.quality, strlen(f.content) as n_bytes
from labels l join f using (doc_id)""")
def find_files(spark, sf):
    files = t.files(spark, sf)
    wanted = t.table(spark, sf, "labels").join(files.select("doc_id", "path"), "doc_id")
    found = op.find_files(files.select("path", "content"), wanted)
    return found.select("doc_id", "path", "quality", F.octet_length("content").cast("bigint").alias("n_bytes"))


@query("b8_membership", f"""
with f as ({t.FILES}), a as ({t.ANALYSES})
select path, t0 = 't1' or t1 = 't1' as has_target from a""")
def membership(spark, sf):
    return t.file_analyses(spark, sf).select("path", F.array_contains("targets", "t1").alias("has_target"))


def _mixed(spark, sf):
    """Files, with unlabelled ones emptied and Spanish ones without extension."""
    labels = t.table(spark, sf, "labels").select("doc_id", "quality")
    files = t.files(spark, sf).join(labels, "doc_id", "left")
    bare = F.regexp_replace("path", r"[.]txt\z", "")
    return files.select(
        bare.alias("path"), F.when(F.col("quality").isNull(), "").otherwise(F.col("content")).alias("content")
    )


MIXED = f"""
with f as ({t.FILES}), m as (
  select regexp_replace(path, '[.]txt$', '') as path,
         case when quality is null then '' else content end as content
  from f left join labels using (doc_id)),
r as (select *, case when content = '' then 'empty file content'
                     when path not like '%.%' then 'file has no extension' end as reason from m)"""


@query("b9_rejects", MIXED + " select path, reason from r where reason is not null")
def rejects(spark, sf):
    return split_rejects(_mixed(spark, sf))[1].select("path", "reason")


@query("b9_accepted", MIXED + " select path, content from r where reason is null")
def accepted(spark, sf):
    return split_rejects(_mixed(spark, sf))[0]
