"""Reference edges over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.functions.labels import edge_key, relation_type
from sourceloom.operators import edges as op
from sourceloom.plans import adapters as t
from sourceloom.plans.registry import query

PARENT = t.sql_dir("dir")
KNOWN = f"""
p as ({t.PATHS}),
known as (
  select distinct array_to_string(string_split(path, '/')[1:i], '/') as path
  from p, unnest(range(1, len(string_split(path, '/')) + 1)) as u(i) union select '.')"""
IMPORTS = f"""
{KNOWN},
links as (
  select page_id, {t.sql_dir('path')} as dir, u.ord - 1 as ord,
         substr(regexp_extract_all(html, 'href="([^"]*)"', 1)[u.ord], 2) || '.x' as dep
  from p, unnest(range(1, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) + 1)) as u(ord)),
pkgs as (select page_id, dir, split_part(dep, '.', 1) as pkg, min(ord) as ord from links group by 1, 2, 3),
cands as (
  select page_id, pkg, ord, 0 as pos,
         case when dir = '.' then '../' || pkg when {PARENT} = '.' then pkg else {PARENT} || '/' || pkg end as path
  from pkgs union all
  select page_id, pkg, ord, 1, case when dir = '.' then pkg else dir || '/' || pkg end from pkgs),
imports as (
  select concat('d', page_id) as source_id, arg_min(path, pos) as target_id, 'imports' as type, min(ord) as ord
  from cands semi join known using (path) group by page_id, pkg)"""
RELATIONS = f"""
rels as (
  select concat('d', page_id) as source_id, {t.sql_dir('path')} as dir,
         case when page_id % 2 = 0 then '' else 'x' end || {t.sql_base('path')} as name,
         case page_id % 3 when 0 then 'creates' when 1 then 'calls' else 'uses' end as type
  from p),
relations as (
  select source_id, coalesce(known.path, name) as target_id, type
  from rels left join known on known.path = case when dir = '.' then name else dir || '/' || name end)"""
IMPLEMENTS = f"""
m as ({t.METHODS}),
s as (
  select c_custkey, c_nationkey, c_mktsegment, coalesce(list(method) filter (where method is not null), []) as methods
  from customer left join m on o_custkey = c_custkey group by all),
implements as (
  select concat('c', a.c_custkey) as source_id, concat('c', b.c_custkey) as target_id
  from s a join s b on a.c_nationkey = b.c_nationkey and a.c_custkey // 600 = b.c_custkey // 600
  where a.c_mktsegment in ('BUILDING', 'MACHINERY') and b.c_mktsegment in ('HOUSEHOLD', 'MACHINERY')
    and list_has_all(a.methods, b.methods))"""


@query("d1_import_edges", f"with {IMPORTS} select source_id, target_id, ord from imports")
def import_edges(spark, sf):
    known = op.known_paths(t.page_paths(spark, sf))
    edges = op.import_edges(t.page_documents(spark, sf), known)
    return edges.select("source_id", "target_id", F.col("ord").cast("bigint").alias("ord"))


@query("d1_known_paths", f"with {KNOWN} select path from known")
def known_paths(spark, sf):
    return op.known_paths(t.page_paths(spark, sf))


@query("d2_relation_edges", f"with {KNOWN}, {RELATIONS} select source_id, target_id, type from relations")
def relation_edges(spark, sf):
    known = op.known_paths(t.page_paths(spark, sf))
    return op.relation_edges(t.page_documents(spark, sf), known).select("source_id", "target_id", "type")


@query("d3_implements", f"with {IMPLEMENTS} select source_id, target_id from implements")
def implements(spark, sf):
    return op.implements_pairs(t.method_sides(spark, sf))


@query("d4_all_edges", f"""
with {IMPORTS}, {RELATIONS}, {IMPLEMENTS},
u as (
  select source_id, target_id, type, 0 as producer from imports
  union all select source_id, target_id, type, 1 from relations
  union all select source_id, target_id, 'implements', 2 from implements)
select {t.sql_key('source_id', 'target_id', 'type')} as ref_key, source_id, target_id, type, min(producer) as producer
from u group by source_id, target_id, type""")
def all_edges(spark, sf):
    docs = t.page_documents(spark, sf)
    known = op.known_paths(t.page_paths(spark, sf))
    pairs = op.implements_pairs(t.method_sides(spark, sf)).select(
        "source_id", "target_id", F.lit("implements").alias("type"), F.lit(0).alias("ord")
    )
    return op.merge_edges(op.import_edges(docs, known), op.relation_edges(docs, known), pairs)


@query("d4_resolved_targets", f"""
with {KNOWN}, {RELATIONS}, o as (select path, min(concat('d', page_id)) as id from p group by 1)
select source_id, target_id, type, o.id as target_doc_id from relations left join o on o.path = target_id""")
def resolved_targets(spark, sf):
    docs = t.page_documents(spark, sf)
    known = op.known_paths(t.page_paths(spark, sf))
    one_per_path = docs.groupBy("path").agg(F.min("id").alias("id"))
    edges = op.relation_edges(docs, known).drop("ord")
    return op.resolve_targets(edges, one_per_path).select("source_id", "target_id", "type", "target_doc_id")


@query("d5_edge_keys", f"""
with e as ({t.EDGES}), k as (select source_id, target_id, {t.sql_relation_type('raw_type')} as type from e)
select {t.sql_key('source_id', 'target_id', 'type')} as ref_key, count(*) as n from k group by 1""")
def edge_keys(spark, sf):
    key = edge_key("source_id", "target_id", relation_type("raw_type"))
    return t.edges(spark, sf).select(key.alias("ref_key")).groupBy("ref_key").agg(F.count(F.lit(1)).alias("n"))


@query("d6_relation_types", f"""
with e as ({t.EDGES})
select raw_type, {t.sql_relation_type('raw_type')} as type, count(*) as n from e group by 1, 2""")
def relation_types(spark, sf):
    typed = t.edges(spark, sf).select("raw_type", relation_type("raw_type").alias("type"))
    return typed.groupBy("raw_type", "type").agg(F.count(F.lit(1)).alias("n"))


# Labels as a model may write them, and the type of each: all known ones, padded, in other
# letter cases, inside longer texts (the first known one counts), and unknown ones.
LABELS = [
    ("instantiation", "creates"), ("Instantiates", "creates"), ("usage", "uses"), ("USES", "uses"), ("method call", "calls"),
    (" Method Invocation ", "calls"), ("invokes", "calls"), ("calls", "calls"), ("containment", "contains"), ("method-of", "belongs-to"),
    ("method-to-struct", "belongs-to"), ("Method-Belongs-To", "belongs-to"), ("method-belongs-to-struct", "belongs-to"),
    ("association", "relates"), ("has-method", "defines"), ("defines method", "defines"), ("implements", "implements"),
    ("it reuses that", "uses"), ("usage by method call", "uses"), ("partly implements", "implements"), ("Owns", "owns"), ("", ""),
]


@query("d6_all_labels", f"""
with l as (
  select [{', '.join(f"'{a}'" for a, _ in LABELS)}][1 + (l_orderkey + l_linenumber) % {len(LABELS)}] as raw_type from lineitem),
known(raw_type, type) as (values {', '.join(f"('{a}', '{b}')" for a, b in LABELS)})
select raw_type, type, count(*) as n from l join known using (raw_type) group by 1, 2""")
def all_labels(spark, sf):
    at = ((F.col("l_orderkey") + F.col("l_linenumber")) % len(LABELS) + 1).cast("int")
    labels = t.table(spark, sf, "lineitem").select(F.element_at(F.array(*[F.lit(a) for a, _ in LABELS]), at).alias("raw_type"))
    typed = labels.select("raw_type", relation_type("raw_type").alias("type"))
    return typed.groupBy("raw_type", "type").agg(F.count(F.lit(1)).alias("n"))


@query("d7_adjacency", f"""
with e as ({t.EDGES}),
r as (select source_id, target_id, (l_orderkey, l_linenumber, l_partkey, l_suppkey) as seq from e)
{t.sql_parts('source_id', 'target_id', 'seq', 'r', 'targets', "','")}""")
def adjacency(spark, sf):
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = t.edges(spark, sf).select(
        F.col("source_id").alias("from"), F.col("target_id").alias("to"), seq.alias("seq")
    )
    return op.adjacency(rows).withColumnRenamed("from", "source_id")
