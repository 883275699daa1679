"""Project aggregation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.operators import project as op
from sourceloom.plans import adapters as t
from sourceloom.plans.registry import query
from sourceloom.sources.tree import classify_files

ROOT = "root"
WITH = f"with f as ({t.FILES}), k as ({t.KINDS})"
REL = "substr(path, 6)"
COMP = f"""
c as (select *, replace(path, '/', chr(1)) as walk,
        case when path like '%.csproj' then {REL} else {t.sql_dir(REL)} end as comp_path from k)"""
TYPED = """case when language = 'go' then 'package' when path like '%.csproj' then 'project' else 'unknown' end"""


def _files(spark, sf):
    return classify_files(t.files(spark, sf))


@query("c1_project_type", f"""
with f as ({t.FILES} union all
  select -1, concat('root/', source, case lang when 'de' then '/all.sln' else '/go.mod' end), '', '' from documents)
select coalesce(arg_min(case when path like '%go.mod' then 'go-module' else 'dotnet-solution' end,
                        replace(path, '/', chr(1))), 'unknown') as project_type
from f where path like '%go.mod' or path like '%.sln'""")
def project_type(spark, sf):
    """Every document's source has a marker file, of a kind that depends on the language."""
    kind = F.when(F.col("lang") == "de", "/all.sln").otherwise("/go.mod")
    markers = t.table(spark, sf, "documents").select(F.concat(F.lit("root/"), "source", kind).alias("path"))
    return op.project_type(t.files(spark, sf).select("path").unionByName(markers))


@query("c2_main_language", f"""
{WITH} select language from k group by language order by count(*) desc, language limit 1""")
def main_language(spark, sf):
    return op.main_language(_files(spark, sf))


@query("c3_display_language", f"""
with f as ({t.FILES})
select coalesce(arg_min(case when path like '%.go' then 'Go' else 'C#' end, path), 'unknown') as language
from f where path like '%.go' or path like '%.cs'""")
def display_language(spark, sf):
    return op.display_language(t.files(spark, sf))


@query("c4_components", f"""
{WITH}, {COMP}
select comp_path, arg_min({TYPED}, walk) as type, {t.sql_base('comp_path')} as name, count(*) as n_files
from c group by comp_path""")
def components(spark, sf):
    return op.components(_files(spark, sf), ROOT)


@query("c4_component_files", f"""
{WITH}, {COMP}
{t.sql_parts('comp_path', 'path', 'walk', 'c', 'files', 'chr(10)')}""")
def component_files(spark, sf):
    return op.component_files(_files(spark, sf), ROOT)


@query("c5_component_type", f"{WITH} select path, {TYPED} as type from k")
def component_type(spark, sf):
    return _files(spark, sf).select("path", op.component_type("language", "path").alias("type"))


ROLLED = f"""
{WITH}, {COMP}, a as ({t.ANALYSES}),
p as (select comp_path, coalesce(arg_min(purpose, walk) filter (where purpose <> ''), '') as description
      from c join a using (path) group by comp_path),
g as (select comp_path, walk, 0 as pos, t0 as target from c join a using (path)
      union all select comp_path, walk, 1, t1 from c join a using (path)),
d as (select comp_path, target, min((walk, pos)) as first from g group by 1, 2),
q as (select comp_path, string_agg(target, ',' order by first) as "references", count(*) as n_references
      from d group by 1)"""


@query("c6_component_rollup", f"""{ROLLED}
select comp_path, description, "references" from p join q using (comp_path)""")
def component_rollup(spark, sf):
    """No component has more than seven targets here, so each list is one part."""
    files, analyses = _files(spark, sf), t.file_analyses(spark, sf)
    placed = op.with_component(files.select("path"), ROOT)
    raw = placed.select("comp_path").unionByName(placed.select("comp_path"))  # two targets a file
    references = op.component_reference_parts(op.component_references(files, analyses, ROOT), raw=raw)
    return op.component_descriptions(files, analyses, ROOT).join(references, "comp_path").select(
        "comp_path", "description", "references"
    )


@query("c7_project", f"""{ROLLED},
n as (select comp_path, arg_min({TYPED}, walk) as type, count(*) as n_files from c group by 1)
select 'root' as root, (select language from k group by 1 order by count(*) desc, language limit 1) as language,
       'unknown' as project_type, comp_path, n.type, {t.sql_base('comp_path')} as name, n_files,
       description, n_references
from n join p using (comp_path) join q using (comp_path)""")
def project(spark, sf):
    return op.project(_files(spark, sf), t.file_analyses(spark, sf), ROOT)


@query("c8_file_components", f"""
with f as ({t.FILES})
select {t.sql_base('path')} as name, path, 'file' as type, content as description, 2::bigint as n_references from f""")
def file_components(spark, sf):
    comps = op.file_components(t.files(spark, sf))
    return op.file_component_counts(comps, t.targets(spark, sf))


@query("c9_by_package", f"""
with f as ({t.FILES}), p as (select path, {t.sql_base('path')} as name, {t.sql_dir('path')} as package from f)
select name, path, package, row_number() over (partition by package order by name, path) as ord from p""")
def by_package(spark, sf):
    return op.by_package(op.file_components(t.files(spark, sf)).select("name", "path"))
