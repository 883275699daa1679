"""Navigation and pages over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.functions.paths import document_id
from sourceloom.operators import navigation as nav
from sourceloom.operators import pages as op
from sourceloom.operators.edges import normalised_edges
from sourceloom.operators.lookups import edge_counts, search, search_rows
from sourceloom.operators.project import file_components
from sourceloom.plans import adapters as t
from sourceloom.plans.lookups import KEYED
from sourceloom.plans.registry import query
from sourceloom.sources import keyed

GRAPH = f"e as ({t.EDGES}), k as ({KEYED}), d as ({t.DOCS})"


@query("j1_diagram", f"""
with {GRAPH}, l as (
  select 1 as pg, 0 as kind, '' as k1, '' as k2, '' as k3, '```mermaid' || chr(10) || 'graph TD' || chr(10) as line
  union all select 1, 1, path, content, '', '  ' || replace(path, '/', '_') || '[' || content || ']' || chr(10) from d
  union all select 1, 2, a.path, b.path, k.type,
    '  ' || replace(a.path, '/', '_') || ' --> |' || k.type || '| ' || replace(b.path, '/', '_') || chr(10)
    from k join d a on a.id = k.source_id join d b on b.id = k.target_id
  union all select 1, 3, '', '', '', '```'),
x as ({t.sql_parts('pg', 'line', 'kind, k1, k2, k3', 'l', 'body')})
select part, body as diagram from x""")
def diagram(spark, sf):
    docs = t.documents(spark, sf)
    ids = docs.select("id", "path")
    refs = normalised_edges(t.edges(spark, sf))
    edges = refs.join(ids.toDF("source_id", "source"), "source_id").join(ids.toDF("target_id", "target"), "target_id")
    return op.diagram(docs.select("path", F.col("content").alias("name")), edges, raw=t.raw_edges(spark, sf))


TREE = f"""
p as ({t.PATHS}),
g as (
  select array_to_string(string_split(path, '/')[1:i], '/') as node_path, path
  from p, unnest(range(1, len(string_split(path, '/')))) as u(i)),
n as (
  select node_path, min(path) || '.html' as url, min(path) as first_path, 0 as kind from g group by 1
  union all select path, path || '.html', path, 1 from p),
m as (
  select *, case when node_path like '%/%' then {t.sql_dir('node_path')} else '' end as parent_path,
         {t.sql_base('node_path')} as title, length(node_path) - length(replace(node_path, '/', '')) as depth from n),
tree as (
  select node_path, parent_path, title, url, depth, 2 * (depth = 0)::int + row_number() over (
    partition by parent_path order by case when depth = 0 then first_path else title end, kind, node_path, first_path) as ord
  from m
  union all select 'index.html', '', 'Home', 'index.html', 0, 1
  union all select 'search.html', '', 'Search', 'search.html', 0, 2)"""


def _paths(spark, sf):
    """Page paths; one of them occurs twice and gives two equal entries."""
    return t.page_paths(spark, sf).select("path")


@query("j2_directory_nav", f"with {TREE} select node_path, parent_path, title, url, depth::int as depth, ord from tree")
def directory_nav(spark, sf):
    return nav.directory_nav(_paths(spark, sf))


COMPS = f"""
f as ({t.FILES}),
c as (select path, {t.sql_base('path')} as name, content as description, {t.sql_dir('path')} as package,
             {t.sql_component_url('path', t.sql_base('path'))} as url from f)"""


def _components(spark, sf):
    return file_components(t.files(spark, sf))


@query("j3_package_nav", f"""
with {COMPS}, g as (select distinct package from c)
select 'overview' as node_path, '' as parent_path, 'Overview' as title, 'index.html' as url, 0 as depth, 1::bigint as ord
union all select 'packages', '', 'Packages', '', 0, 2 where exists (select 1 from c)
union all select 'packages/' || package, 'packages', {t.sql_base('package')}, '', 1, row_number() over (order by package) from g
union all select 'packages/' || package || '/' || path, 'packages/' || package, name, url, 2,
                 row_number() over (partition by package order by name, path) from c""")
def package_nav(spark, sf):
    return nav.package_nav(_components(spark, sf).select("path", "name"))


INDEX = f"""
{COMPS}, g as (select distinct package from c),
l as (
  select 'index.html' as out_path, 0 as place, '' as package, 0 as kind, '' as name, '' as path,
         '# Project Documentation' || chr(10) || chr(10) || '## Components' || chr(10) || chr(10) as line
  union all select 'index.html', 1, package, 0, '', '',
         case when package = 'root' then '### Root Package' else '### Package ' || package end || chr(10) || chr(10) from g
  union all select 'index.html', 1, package, 1, name, path, '- [' || name || '](' || url || ') - ' || description || chr(10) from c
  union all select 'index.html', 1, package, 2, '', '', chr(10) from g),
index_parts as ({t.sql_parts('out_path', 'line', 'place, package, kind, name, path', 'l', 'body')})"""


@query("j4_index_page", f"with {INDEX} select out_path, 'Overview' as title, part, body as body_md from index_parts")
def index_page(spark, sf):
    return op.index_page(_components(spark, sf)).drop("last_updated")


PAGE = f"""
{COMPS}, r as ({t.REFS}),
named as (select name, arg_min(url, path) as url from c group by 1),
shared as (select url, count(*) > 1 as collision from c group by 1),
cl as (
  select path, 0 as section, 0 as pos, '# ' || name || chr(10) || chr(10) || '**Type:** file' || chr(10) || chr(10)
    || case when description <> '' then '## Overview' || chr(10) || chr(10) || description || chr(10) || chr(10) else '' end
    || '## Package' || chr(10) || chr(10)
    || case when package = '.' then 'Root package' else 'Package `' || package || '`' end || chr(10) || chr(10)
    || '## Files' || chr(10) || chr(10) || chr(10)
    || '## Dependencies' || chr(10) || chr(10) as line from c
  union all select r.path, 1, pos, '- [' || target || ']('
    || coalesce(named.url, 'components/' || {t.sql_slug('target')} || '.html') || ')' || chr(10)
    from r left join named on named.name = r.target
  union all select path, 2, 0, chr(10) from c),
component_parts as (select path, string_agg(line, '' order by section, pos) as body from cl group by 1)"""


@query("j5_component_pages", f"""
with {PAGE}
select path, c.url as out_path, name as title, 0::bigint as part, body as body_md, collision
from component_parts join c using (path) join shared on shared.url = c.url""")
def component_pages(spark, sf):
    """Files as components: they list no files and reference two names each."""
    comps = _components(spark, sf)
    none = t.files(spark, sf).where(F.lit(False)).select("path", F.lit(0).alias("pos"), F.col("path").alias("file"))
    return op.component_pages(comps, none, t.targets(spark, sf)).drop("last_updated")


MODULES = f"""
{GRAPH},
ends as (
  select 1 as section, source_id as page_id, target_id as far_id, type from k
  union all select 2, target_id, source_id, type from k),
ml as (
  select page_id, section, far_id, ends.type as type, '- [' || b.path || ']('
         || repeat('../', length(a.path) - length(replace(a.path, '/', ''))) || b.path || '.html)' || chr(10) as line
  from ends join d a on a.id = page_id join d b on b.id = far_id),
mh as (
  select *, case when row_number() over (partition by page_id, section order by far_id, type) > 1 then ''
         else chr(10) || chr(10) || case section when 1 then '## Dependencies' else '## Used By' end || chr(10) || chr(10)
         end as head from ml),
mp as ({t.sql_parts('page_id', 'line', 'section, far_id, type', 'mh', 'body', text='head || line')}),
module_parts as (
  select path || '.html' as out_path, path as title, d.type, coalesce(part, 0) as part,
         case when coalesce(part, 0) = 0 then content else '' end || coalesce(body, '') as body_md
  from d left join mp on page_id = id)"""


@query("j6_module_pages", f"with {MODULES} select out_path, title, part, body_md from module_parts")
def module_pages(spark, sf):
    pages = op.module_pages(t.documents(spark, sf), normalised_edges(t.edges(spark, sf)), raw=t.raw_edges(spark, sf))
    return pages.drop("last_updated")


@query("j6_stored_pages", f"with {MODULES} select out_path, title, part, body_md from module_parts")
def stored_pages(spark, sf):
    """Pages of stored documents and references."""
    by_source, by_target = (keyed.rows(spark, x) for x in t.saved_references(spark, sf))
    docs = keyed.rows(spark, t.saved_documents(spark, sf))
    return op.module_pages(docs, by_source, by_target=by_target).drop("last_updated")


@query("j7_overview", f"""
with d as ({t.DOCS})
select coalesce(arg_min(content, id), '') as overview from d where type = 'architecture'""")
def overview(spark, sf):
    return op.overview(t.documents(spark, sf))


@query("j8_search_rows", f"""
with f as ({t.FILES})
select path, {t.sql_base('path')} as title, content as description from f
where contains(lower({t.sql_base('path')}), 'doc_1') or contains(lower(content), 'doc_1')""")
def search_page(spark, sf):
    return search(search_rows(t.files(spark, sf)), "DOC_1")


@query("j11_nav_flags", f"""
with {TREE}
select t.node_path, parent_path, title, url, depth::int as depth, ord, url = 'search.html' as active,
       exists (select 1 from tree c where c.parent_path = t.node_path) as has_children
from tree t""")
def nav_flags(spark, sf):
    return nav.nav_flags(nav.directory_nav(_paths(spark, sf)), "search.html")


@query("a9_documentation_pages", f"""
with {INDEX}, {PAGE.replace(COMPS + ',', '', 1).strip()}
select out_path, 'Overview' as title, part, body as body_md from index_parts
union all select c.url, name, 0, body from component_parts join c using (path)""")
def documentation_pages(spark, sf):
    """Index and component pages in the shape of the pages table."""
    return op.documentation_pages(t.files(spark, sf), t.targets(spark, sf)).drop("last_updated")


@query("a9_wiki_pages", f"""
with {MODULES}, h as (select content from d where type = 'architecture' order by id limit 1)
select 'index.html' as out_path, 'Home' as title, 0::bigint as part,
       coalesce((select content from h), '') as body_md
union all select 'architecture.html', 'Architecture', 0, content from h
union all select 'search.html', 'Search', 0, ''
union all select out_path, title, part, body_md from module_parts where type = 'module'""")
def wiki_pages(spark, sf):
    """Home, architecture, module and search pages in the shape of the pages table."""
    refs = normalised_edges(t.edges(spark, sf))
    return op.wiki_pages(t.documents(spark, sf), refs, raw=t.raw_edges(spark, sf)).drop("last_updated")


@query("j6_linked_documents", f"""
with {MODULES},
o as (select source_id, count(*) as n from k group by 1), i as (select target_id, count(*) as n from k group by 1)
select d.id, substr(sha256(d.path), 1, 16) as doc_hash, d.path, coalesce(o.n, 0) as n_deps,
       coalesce(i.n, 0) as n_used_by, part, body_md
from d left join o on o.source_id = d.id left join i on i.target_id = d.id
join module_parts m on m.title = d.path""")
def linked_documents(spark, sf):
    """Flagship: edges normalised and deduplicated, degrees, and the page of each document."""
    docs, refs = t.documents(spark, sf), normalised_edges(t.edges(spark, sf))
    counted = edge_counts(docs.select("id", "path"), refs)
    pages = op.module_pages(docs, refs, raw=t.raw_edges(spark, sf)).withColumnRenamed("title", "path")
    return counted.join(pages, "path").select(
        "id", document_id("path").alias("doc_hash"), "path", "n_deps", "n_used_by", "part", "body_md"
    )
