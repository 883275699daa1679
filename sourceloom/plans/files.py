"""Sources and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.functions.labels import relation_type
from sourceloom.operators.analysis import analysis_documents, parse_analysis, response_documents
from sourceloom.operators.edges import normalised_edges
from sourceloom.operators.skew import PART_BYTES
from sourceloom.plans import adapters as t
from sourceloom.plans.registry import query
from sourceloom.schemas import REFERENCE
from sourceloom.session import new_folder
from sourceloom.sources import keyed
from sourceloom.sources.records import decode_rows, encode_rows
from sourceloom.sources.store import upsert_documents, upsert_references
from sourceloom.sources.tree import classify_files, scan_tree, with_extensions
from sourceloom.sources.tree_source import read_tree

FIXED_TIME = "2024-01-01 00:00:00"


@query("a1_scan_tree", """
select table_name || '.parquet' as name, 'PAR1' as head, 'PAR1' as tail from information_schema.tables
where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
  'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')""")
def scan(spark, sf):
    """The table files themselves, with the marks that their content begins and ends with."""
    parts = scan_tree(spark, sf, ["parquet"], part_bytes=PART_BYTES).select(
        "path", "part", F.left("content", F.lit(4)).alias("head"), F.right("content", F.lit(4)).alias("tail")
    )
    # Dealt by path first, or else the sort below the aggregate would sort whole content.
    marks = parts.repartition("path").groupBy("path").agg(F.min_by("head", "part").alias("head"), F.max_by("tail", "part").alias("tail"))
    return marks.select(F.substring_index("path", "/", -1).alias("name"), "head", "tail")


@query("a1_tree_source", """
select table_name || '.parquet' as name, length(table_name) + 8 as n from information_schema.tables
where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
  'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')""")
def tree_source_listing(spark, sf):
    """The table files by the data source, listed without opening any."""
    name = F.substring_index("path", "/", -1)
    found = read_tree(spark, sf, ["parquet"], content=False).where("length > 0")
    return found.select(name.alias("name"), F.length(name).cast("bigint").alias("n"))


@query("a2_extension_filter", f"""
with f as ({t.FILES})
select path, strlen(content) as n_bytes from f
where regexp_extract(path, '([.][^./]*)$', 1) in ('.go', '.CS', '.java')""")
def extension_filter(spark, sf):
    kept = with_extensions(t.files(spark, sf), [" go", ".CS ", "java", ".cs"])
    return kept.select("path", F.octet_length("content").cast("bigint").alias("n_bytes"))


@query("a3_classify_files", f"""
with f as ({t.FILES}), k as ({t.KINDS})
select path, language, type from k""")
def classify(spark, sf):
    return classify_files(t.files(spark, sf).select("path")).select("path", "language", "type")


@query("a4_upsert_documents", f"""
with f as ({t.FILES})
select substr(sha256(path), 1, 16) as id, path,
       case when l.doc_id is null then content
            else concat('quality ', l.quality, ' toxic ', l.toxic) end as content
from f left join labels l using (doc_id)""")
def upsert_docs(spark, sf):
    files = t.files(spark, sf)
    current = files.select(F.substring(F.sha2("path", 256), 1, 16).alias("id"), "path", "content")
    labels = t.table(spark, sf, "labels")
    relabelled = files.select("doc_id", "path").join(labels, "doc_id")
    text = F.concat(F.lit("quality "), "quality", F.lit(" toxic "), "toxic")
    key = F.substring(F.sha2("path", 256), 1, 16).alias("id")
    batch = relabelled.select(key, "path", F.lit("draft").alias("content"), F.lit(1).alias("seq")).unionByName(
        relabelled.select(key, "path", text.alias("content"), F.lit(2).alias("seq"))
    )
    return upsert_documents(current, batch)


@query("a5_upsert_edges", f"""
with e as ({t.EDGES}),
d as (select source_id, target_id, {t.sql_relation_type('raw_type')} as type, l_orderkey, l_linenumber from e)
select source_id, target_id, type, max(l_orderkey * 10 + l_linenumber) as last_seen
from d group by source_id, target_id, type""")
def upsert_edges(spark, sf):
    """Lines are written in order; the table starts empty and keeps the last per key."""
    seen = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("last_seen")
    batch = t.edges(spark, sf).select(
        "source_id", "target_id", relation_type("raw_type").alias("type"), seen, seen.alias("seq")
    )
    empty = batch.drop("seq").where(F.lit(False))
    return upsert_references(empty, batch)


@query("a4_saved_batches", f"""
with f as ({t.FILES}), b as (
  select path, content, lang, 0 as seq from f
  union all select path, 'draft', lang, 1 from f join labels using (doc_id)
  union all select path, concat('quality ', quality, ' toxic ', toxic), lang, 2 from f join labels using (doc_id)
  union all select concat('copy/', path), content, 'copy', 2 from f join labels using (doc_id) where toxic = 1)
select substr(sha256(path), 1, 16) as id, path, arg_max(content, seq) as content, arg_max(lang, seq) as type
from b group by path""")
def saved_documents(spark, sf):
    """Three saves: all files; drafts and then texts of the labelled ones; new ones."""
    files, labels = t.files(spark, sf), t.table(spark, sf, "labels")
    labelled = files.select("doc_id", "path", "lang", "content").join(labels, "doc_id")
    text = F.concat(F.lit("quality "), "quality", F.lit(" toxic "), "toxic")
    row = lambda rows, path, content, kind, seq: rows.select(
        F.substring(F.sha2(path, 256), 1, 16).alias("id"), path.alias("path"), content.alias("content"), kind.alias("type"), F.lit(seq).alias("seq"))
    path = F.col("path")
    batches = [
        row(files, path, F.col("content"), F.col("lang"), 0),
        row(labelled, path, text, F.col("lang"), 2).unionByName(row(labelled, path, F.lit("draft"), F.col("lang"), 1)),
        row(labelled.where("toxic = 1"), F.concat(F.lit("copy/"), path), F.col("content"), F.lit("copy"), 2),
    ]
    saved = keyed.KeyedTable(new_folder(spark, "documents"), batches[0].drop("seq").schema, ("id",), "id", 8)
    for batch in batches:
        keyed.save(batch, saved)
    return keyed.rows(spark, saved)


@query("a5_saved_batches", f"""
with e as ({t.EDGES}),
d as (select source_id, target_id, {t.sql_relation_type('raw_type')} as type, l_orderkey, l_linenumber from e)
select source_id, target_id, type, 2::bigint as n_tables,
       coalesce(max(l_orderkey * 10 + l_linenumber) filter (l_linenumber > 2), max(l_orderkey * 10 + l_linenumber)) as last_seen
from d group by source_id, target_id, type""")
def saved_references(spark, sf):
    """Two saves into both tables of references, and what both hold: the later save counts."""
    by_source, by_target = t.saved_references(spark, sf)
    both = keyed.rows(spark, by_source).unionByName(keyed.rows(spark, by_target))
    return both.groupBy("source_id", "target_id", "type", "last_seen").agg(F.count(F.lit(1)).alias("n_tables"))


@query("a6_json_round_trip", f"""
with f as ({t.FILES})
select doc_id, path, content, lang from f""")
def json_round_trip(spark, sf):
    files = t.files(spark, sf)
    return decode_rows(encode_rows(files, "doc_id"), files.schema)


@query("a6_edge_json", f"""
with e as ({t.EDGES})
select distinct source_id, target_id, {t.sql_relation_type('raw_type')} as type from e""")
def edge_json(spark, sf):
    edges = normalised_edges(t.edges(spark, sf)).withColumn("created_at", F.lit(FIXED_TIME).cast("timestamp"))
    return decode_rows(encode_rows(edges.drop("ref_key"), "source_id"), REFERENCE).drop("created_at")


@query("a7_analysis_documents", f"""
with a as ({t.ANSWERS})
select substr(sha256(path), 1, 16) as id, path, 'module' as type, purpose as content, purpose,
       case when l_returnflag = 'R' then '' else part || ':struct,' || supp || ':interface' end as components,
       part || '>' || supp || ':usage,' || supp || '>' || part || ':association,'
         || part || '>' || part || ':containment' as relations,
       l_returnflag || ',' || l_linestatus as insights
from a where ok""")
def documents_of_answers(spark, sf):
    good, _ = parse_analysis(t.analysis_responses(spark, sf))
    docs = analysis_documents(good, FIXED_TIME)
    return docs.select(
        "id", "path", "type", "content", "purpose",
        F.array_join(F.transform("components", lambda c: F.concat(c["name"], F.lit(":"), c["type"])), ",").alias("components"),
        F.array_join(
            F.transform("relations", lambda r: F.concat(r["from"], F.lit(">"), r["to"], F.lit(":"), r["type"])), ","
        ).alias("relations"),
        F.array_join("insights", ",").alias("insights"),
    )


@query("a8_response_documents", f"""
with f as ({t.FILES})
select substr(sha256(path), 1, 16) as id, path, 'module' as type, content,
       0::bigint as n_references from f""")
def documents_of_responses(spark, sf):
    responses = t.files(spark, sf).select("path", F.col("content").alias("response"))
    return response_documents(responses, FIXED_TIME).select(
        "id", "path", "type", "content", F.size("references").cast("bigint").alias("n_references")
    )
