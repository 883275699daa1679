"""Path, id, URL and format columns over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.functions import formats, paths
from sourceloom.plans import adapters as t
from sourceloom.plans.registry import query

P = f"with p as ({t.PATHS}), f as ({t.FILES})"
DIR, BASE = t.sql_dir("path"), t.sql_base("path")
PARENT = t.sql_dir(DIR)


@query("h1_file_ext", f"""{P}
select path, regexp_extract(path, '([.][^./]*)$', 1) as ext, lower(regexp_extract(path, '([.][^./]*)$', 1)) as low
from (select path from f union all select path from p)""")
def file_ext(spark, sf):
    both = t.files(spark, sf).select("path").unionByName(t.page_paths(spark, sf).select("path"))
    return both.select("path", paths.file_ext("path").alias("ext"), F.lower(paths.file_ext("path")).alias("low"))


@query("h2_document_id", f"{P} select page_id, substr(sha256(path), 1, 16) as id from p")
def document_id(spark, sf):
    return t.page_paths(spark, sf).select("page_id", paths.document_id("path").alias("id"))


@query("h3_package_id", f"""{P}
select page_id, substr(sha256(
  case when {DIR} = '.' then 'main' else {t.sql_base(DIR)} end || ':' || {BASE}), 1, 16) as id from p""")
def package_id(spark, sf):
    return t.page_paths(spark, sf).select("page_id", paths.package_id("path").alias("id"))


@query("h4_path_parts", f"""{P}
select page_id, {DIR} as dir, {BASE} as base,
       case when {DIR} = '.' then '../x/' || {BASE} when {PARENT} = '.' then 'x/' || {BASE}
            else {PARENT} || '/x/' || {BASE} end as joined,
       path as cleaned, case when path = split_part(path, '/', 1) then '.'
            else substr(path, length(split_part(path, '/', 1)) + 2) end as below_host,
       '../../' || path as from_elsewhere
from p""")
def path_parts(spark, sf):
    p = t.page_paths(spark, sf).withColumn("host", F.substring_index("path", "/", 1)).withColumn("dir", paths.dir_name("path"))
    messy = F.concat(F.lit("./"), F.regexp_replace("path", "/", "//./z/../"), F.lit("/"))
    return p.select(
        "page_id", "dir", paths.base_name("path").alias("base"),
        paths.join_path("dir", F.lit("../x"), paths.base_name("path")).alias("joined"),
        paths.clean_path(messy).alias("cleaned"),
        paths.rel_path("host", "path").alias("below_host"),
        paths.rel_path(F.lit("some where/else"), "path").alias("from_elsewhere"),
    )


@query("h5_sanitize_path", f"{P} select page_id, replace(path, '/', '/y/') as clean from p")
def sanitize_path(spark, sf):
    messy = F.concat(F.lit("/./"), F.regexp_replace("path", "/", "/./y/../"))
    return t.page_paths(spark, sf).select("page_id", paths.sanitize_path(messy).alias("clean"))


@query("h6_path_to_url", f"{P} select page_id, path || '.html' as url, path as index_url from p")
def path_to_url(spark, sf):
    rooted = F.concat(F.lit("/"), "path")
    index = F.concat(F.col("path"), F.lit("/index.html"))
    return t.page_paths(spark, sf).select(
        "page_id", paths.path_to_url(rooted).alias("url"), paths.path_to_url(index).alias("index_url")
    )


@query("h7_relative_url", f"""{P}
select page_id, repeat('../', length(path) - length(replace(path, '/', ''))) || 'lib/y.go.html' as url from p""")
def relative_url(spark, sf):
    return t.page_paths(spark, sf).select("page_id", paths.relative_url("path", F.lit("lib/y.go")).alias("url"))


@query("h8_slug", f"{P} select doc_id, {t.sql_slug('path')} as slug from (select doc_id, replace(path, 'doc_', 'My Doc+') as path from f)")
def slug(spark, sf):
    named = F.regexp_replace("path", "doc_", "My Doc+")
    return t.files(spark, sf).select("doc_id", paths.slug(named).alias("slug"))


@query("h9_component_url", f"{P} select page_id, {t.sql_component_url('path', BASE)} as url from p")
def component_url(spark, sf):
    return t.page_paths(spark, sf).select(
        "page_id", paths.component_url("path", paths.base_name("path")).alias("url")
    )


@query("h10_component_link", f"{P} select page_id, '/components/' || replace(path, '/', '-') || '.html' as url from p")
def component_link(spark, sf):
    return t.page_paths(spark, sf).select("page_id", paths.component_link("path").alias("url"))


@query("i1_format_type", """
select event_id, list_aggregate(list_transform(string_split(x, '_'), lambda w: upper(w[1]) || substr(w, 2)), 'string_agg', ' ') as label
from (select event_id, concat(event_type, '_of_user', user_id) as x from events)""")
def format_type(spark, sf):
    name = F.concat("event_type", F.lit("_of_user"), "user_id")
    return t.table(spark, sf, "events").select("event_id", formats.format_type(name).alias("label"))


@query("i2_format_date", "select o_orderkey, strftime(o_orderdate, '%B %-d, %Y') as day from orders")
def format_date(spark, sf):
    return t.table(spark, sf, "orders").select("o_orderkey", formats.format_date("o_orderdate").alias("day"))


@query("i3_impact_class", """
select o_orderkey, case split_part(o_orderpriority, '-', 2) when 'HIGH' then 'badge-danger'
  when 'MEDIUM' then 'badge-warning' when 'LOW' then 'badge-info' else 'badge-secondary' end as class
from orders""")
def impact_class(spark, sf):
    level = F.substring_index("o_orderpriority", "-", -1)
    return t.table(spark, sf, "orders").select("o_orderkey", formats.impact_class(level).alias("class"))


@query("i4_metric_band", """
select c_custkey, case when c_acctbal / 100 >= 80 then 'high' when c_acctbal / 100 >= 60 then 'medium' else 'low' end as band,
       format('{:.1f}', c_acctbal / 100) as shown
from customer""")
def metric_band(spark, sf):
    value = F.col("c_acctbal") / 100
    return t.table(spark, sf, "customer").select(
        "c_custkey", formats.metric_band(value).alias("band"), formats.metric_text(value).alias("shown")
    )
