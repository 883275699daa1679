"""Prompts, answers and their display rows over the given tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from sourceloom.operators import analysis as op
from sourceloom.operators.enrich import Retry, enrich
from sourceloom.operators.pages import cross_reference_rows, insight_rows, metric_rows
from sourceloom.plans import adapters as t
from sourceloom.plans.registry import query
from sourceloom.sources.tree import classify_files

WITH = f"with f as ({t.FILES}), k as ({t.KINDS})"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _filled(template: str, *values: str) -> str:
    texts = template.split("%s")
    return " || ".join([_text(texts[0])] + [f"{v} || {_text(x)}" for v, x in zip(values, texts[1:])])


TEMPLATE = "case " + " ".join(
    f"when language || '_' || type = '{k}' then {_text(v)}" for k, v in op.PROMPTS.items()
) + f" else {_text(op.PROMPTS['go_source'])} end"


@query("e1_analysis_prompts", f"""{WITH}
select path, {_text(op.SYSTEM_PROMPT)} as system_prompt, replace({TEMPLATE}, '%s', content) as prompt from k""")
def analysis_prompts(spark, sf):
    prompted = op.with_analysis_prompt(classify_files(t.files(spark, sf)))
    return prompted.select("path", "system_prompt", "prompt")


@query("e2_enhanced_prompts", f"""{WITH}
select path, {_filled(op.ENHANCED_SYSTEM_PROMPT, 'language')} as system_prompt,
       {_filled(op.ENHANCED_PROMPT, 'language', 'content')} as prompt from k""")
def enhanced_prompts(spark, sf):
    prompted = op.with_enhanced_prompt(classify_files(t.files(spark, sf)))
    return prompted.select("path", "system_prompt", "prompt")


@query("e3_documentation_prompts", f"""
with f as ({t.FILES})
select path, {_filled(op.DOCUMENTATION_PROMPT, "regexp_extract(path, '[.]([^./]*)$', 1)", 'content')} as prompt from f""")
def documentation_prompts(spark, sf):
    return op.with_documentation_prompt(t.files(spark, sf)).select("path", "prompt")


def stub_client():
    """A client whose answer is a pure function of the prompt."""

    def answer(_system: str | None, prompt: str) -> str:
        return f"{len(prompt)}:{hashlib.md5(prompt.encode()).hexdigest()}"

    return answer


def refusing_client():
    answer = stub_client()

    def client(system: str | None, prompt: str) -> str:
        if system == "refuse":
            raise ValueError("refused")
        return answer(system, prompt)

    return client


@query("e4_enrich", f"""
with f as ({t.FILES}),
p as (select path, {_filled(op.DOCUMENTATION_PROMPT, "regexp_extract(path, '[.]([^./]*)$', 1)", 'content')} as prompt from f)
select path, concat(length(prompt), ':', md5(prompt)) as response, null::varchar as error from p""")
def enrich_stub(spark, sf):
    return enrich(op.with_documentation_prompt(t.files(spark, sf)), stub_client)


@query("e4_calls_in_flight", f"""
with f as ({t.FILES}),
p as (
  select path, {_filled(op.DOCUMENTATION_PROMPT, "regexp_extract(path, '[.]([^./]*)$', 1)", 'content')} as prompt, 1 as kind, doc_id from f
  union all select path, path, 2, doc_id from f)
select path, kind, case when doc_id % 3 = 0 and kind = 2 then null else concat(length(prompt), ':', md5(prompt)) end as response,
       case when doc_id % 3 = 0 and kind = 2 then 'ValueError: refused' end as error from p""")
def calls_in_flight(spark, sf):
    """Two prompts per file, eight calls under way in a task; some calls fail."""
    files = t.files(spark, sf)
    short = files.select("path", F.col("path").alias("prompt"), F.lit(2).alias("kind"), (F.col("doc_id") % 3 == 0).alias("refused"))
    long = op.with_documentation_prompt(files).select("path", "prompt", F.lit(1).alias("kind"), F.lit(False).alias("refused"))
    prompts = long.unionByName(short).withColumn("system_prompt", F.when(F.col("refused"), "refuse"))
    return enrich(prompts, refusing_client, Retry(retries=1, base_delay=0), in_flight=8, carry=["kind"])


@query("e5_parse_analysis", f"""
with a as ({t.ANSWERS})
select path, purpose, case when l_returnflag = 'R' then 0 else 2 end::bigint as n_components,
       case when l_returnflag = 'R' then '' else dep end as dependencies,
       part || '>' || supp || ',' || supp || '>' || part || ',' || part || '>' || part as relations,
       l_returnflag || ',' || l_linestatus as insights
from a where ok""")
def parse_analysis(spark, sf):
    good, _ = op.parse_analysis(t.analysis_responses(spark, sf))
    a = F.col("analysis")
    return good.select(
        "path", a["purpose"].alias("purpose"), F.size(a["components"]).cast("bigint").alias("n_components"),
        F.array_join(F.flatten(F.transform(a["components"], lambda c: c["dependencies"])), ",").alias("dependencies"),
        F.array_join(F.transform(a["relationships"], lambda r: F.concat(r["from"], F.lit(">"), r["to"])), ",").alias("relations"),
        F.array_join(a["insights"], ",").alias("insights"),
    )


@query("e5_rejected_answers", f"with a as ({t.ANSWERS}) select path from a where not ok")
def rejected_answers(spark, sf):
    return op.parse_analysis(t.analysis_responses(spark, sf))[1].select("path")


IMPACT = "['High', 'medium', 'LOW', 'other'][c_custkey % 4 + 1]"


@query("e6_parse_enhanced", f"""
select concat('c', c_custkey) as path, 'layered,' || c_mktsegment as patterns,
       round(c_acctbal / 100, 6) as line_coverage, (c_custkey % 100)::double as style_score,
       {IMPACT} as impact, c_name as description, concat('c/', c_custkey, '>n', c_nationkey) as refs
from customer""")
def parse_enhanced(spark, sf):
    good, _ = op.parse_enhanced(t.enhanced_responses(spark, sf))
    a = F.col("analysis")
    metric = lambda k: F.round(F.element_at(a["code_quality_metrics"], k).cast("double"), 6)
    refs = F.transform(
        F.map_entries(a["cross_references"]),
        lambda e: F.concat(e["key"], F.lit(">"), F.array_join(e["value"], "+")),
    )
    return good.select(
        "path", F.array_join(a["architectural_patterns"], ",").alias("patterns"),
        metric("line_coverage").alias("line_coverage"), metric("style_score").alias("style_score"),
        a["insights"][0]["impact"].alias("impact"), a["insights"][0]["description"].alias("description"),
        F.array_join(refs, ",").alias("refs"),
    )


@query("e6_names_in_any_case", f"""
select concat('c', c_custkey) as path, c_mktsegment as patterns,
       case when c_custkey % 3 = 0 then 'Impact=' || c_nationkey || ',Type=x,impact=' || c_custkey % 100 || ',line=2.0'
            else 'Impact=' || c_nationkey || ',impact=' || c_custkey % 100 end as metrics,
       'dead_code:' || {IMPACT} || ':' || c_name as insight,
       case when c_custkey % 3 = 0 then 'Components>n' || c_nationkey || ',components>' else 'Components>n' || c_nationkey end as refs
from customer where c_custkey % 5 <> 0""")
def names_in_any_case(spark, sf):
    """Field names in any letter case, keys of maps as they stand; every fifth answer has a
    text where a list is due."""
    good, _ = op.parse_enhanced(t.enhanced_responses_in_any_case(spark, sf))
    a = F.col("analysis")
    pairs = lambda m, show: F.array_join(F.array_sort(F.transform(F.map_entries(m), show)), ",")
    first = a["insights"][0]
    return good.select(
        "path", F.array_join(a["architectural_patterns"], ",").alias("patterns"),
        pairs(a["code_quality_metrics"], lambda e: F.concat(e["key"], F.lit("="), e["value"])).alias("metrics"),
        F.concat_ws(":", first["type"], first["impact"], first["description"]).alias("insight"),
        pairs(a["cross_references"], lambda e: F.concat(e["key"], F.lit(">"), F.array_join(e["value"], "+"))).alias("refs"),
    )


@query("e7_to_enhanced", f"""
with a as ({t.ANSWERS})
select path, 'general:' || l_returnflag || ':medium,general:' || l_linestatus || ':medium' as insights,
       part || '>' || supp || '+' || part || ',' || supp || '>' || part as cross_references,
       0::bigint as n_patterns, 0::bigint as n_metrics
from a where ok""")
def to_enhanced(spark, sf):
    good, _ = op.parse_analysis(t.analysis_responses(spark, sf))
    converted = good.select("path", op.to_enhanced("analysis").alias("x"))
    x = F.col("x")
    insight = lambda i: F.concat_ws(":", i["type"], i["description"], i["impact"])
    refs = F.transform(
        F.map_entries(x["cross_references"]),
        lambda e: F.concat(e["key"], F.lit(">"), F.array_join(e["value"], "+")),
    )
    return converted.select(
        "path", F.array_join(F.transform(x["insights"], insight), ",").alias("insights"),
        F.array_join(refs, ",").alias("cross_references"),
        F.size(x["architectural_patterns"]).cast("bigint").alias("n_patterns"),
        F.size(x["code_quality_metrics"]).cast("bigint").alias("n_metrics"),
    )


BAND = "case when value >= 80 then 'high' when value >= 60 then 'medium' else 'low' end"


@query("j9_metric_rows", f"""
with m as (
  select concat('c', c_custkey) as path, 'line_coverage' as key, 'Line Coverage' as label, c_acctbal / 100 as value from customer
  union all
  select concat('c', c_custkey), 'style_score', 'Style Score', (c_custkey % 100)::double from customer)
select path, key, label, {BAND} as band, format('{{:.1f}}', value) as value_text from m""")
def metrics(spark, sf):
    return metric_rows(op.parse_enhanced(t.enhanced_responses(spark, sf))[0]).select(
        "path", "key", "label", "band", F.translate("value_text", ",", "").alias("value_text")
    )


@query("j10_cross_reference_rows", """
select concat('c', c_custkey) as path, concat('c/', c_custkey) as target,
       concat('/components/c-', c_custkey, '.html') as url from customer""")
def cross_references(spark, sf):
    return cross_reference_rows(op.parse_enhanced(t.enhanced_responses(spark, sf))[0])


@query("j12_insight_rows", f"""
select concat('c', c_custkey) as path, 'Dead Code' as label, {IMPACT} as impact,
       ['badge-danger', 'badge-warning', 'badge-info', 'badge-secondary'][c_custkey % 4 + 1] as impact_class,
       c_name as description, concat('n/', c_nationkey, ' /components/n-', c_nationkey, '.html') as links
from customer""")
def insights(spark, sf):
    rows = insight_rows(op.parse_enhanced(t.enhanced_responses(spark, sf))[0])
    link = lambda c: F.concat(c["name"], F.lit(" "), c["url"])
    return rows.select(
        "path", "label", "impact", "impact_class", "description",
        F.array_join(F.transform("components", link), ",").alias("links"),
    )
