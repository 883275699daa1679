"""The given tables in the shapes the operators take.

``*_SQL`` texts run on Spark (tables passed in) and, through ``plain``, in the comparison
SQL, so both sides start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions.labels import relation_type
from sourceloom.operators.skew import PART_BYTES, spread
from sourceloom.schemas import COMPONENTS, RELATIONS
from sourceloom.session import new_folder
from sourceloom.sources import keyed

# Files: extension by language; .CS tests lower-casing, .txt is no known kind.
FILES_SQL = """
select doc_id, concat('root/', source, '/', doc_id % 7, '/doc_', doc_id,
         case lang when 'en' then '.go' when 'fr' then '.CS'
                   when 'de' then '.csproj' else '.txt' end) as path,
       text as content, lang
from {documents}"""

# Edges: exact, padded and partial labels, with repeats.
EDGES_SQL = """
select concat('p', l_partkey) as source_id, concat('s', l_suppkey) as target_id,
       case l_returnflag when 'A' then 'Instantiates' when 'N' then ' method call '
                         else 'Reuses it' end as raw_type,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
from {lineitem}"""

# Documents at the ends of those edges.
DOCS_SQL = """
select concat('p', p_partkey) as id, concat(p_brand, '/', p_type, '/p', p_partkey) as path,
       'module' as type, p_name as content
from {part}
union all
select concat('s', s_suppkey), concat('suppliers/s', s_suppkey), 'architecture', s_name
from {supplier}"""

# Page paths without scheme, query and closing slash.
PATHS_SQL = """
select page_id, html,
       regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[/]?([?#].*)?$', '') as path
from {pages}"""

# Methods of customers: one row per customer and method.
METHODS_SQL = """
select distinct o_custkey, concat(o_orderpriority, '/', o_orderstatus) as method from {orders}"""



def plain(sql: str) -> str:
    """The text with table names in place of the passed tables."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


FILES = plain(FILES_SQL)
EDGES = plain(EDGES_SQL)
DOCS = plain(DOCS_SQL)
PATHS = plain(PATHS_SQL)
METHODS = plain(METHODS_SQL)
KINDS = """
select *, case lower(regexp_extract(path, '([.][^./]*)$', 1)) when '.go' then 'go' else 'csharp' end as language,
       case lower(regexp_extract(path, '([.][^./]*)$', 1)) when '.csproj' then 'project' else 'source' end as type
from f where lower(regexp_extract(path, '([.][^./]*)$', 1)) in ('.go', '.cs', '.csproj', '.sln', '.mod')"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cores(spark: SparkSession) -> int:
    """Tasks for costly work per row: the given files are one row group each."""
    return spark.sparkContext.defaultParallelism


def _run(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf, n) for n in names})


def files(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, FILES_SQL)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    used = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
    return spark.sql(EDGES_SQL, lineitem=spread(table(spark, sf, "lineitem").select(used), cores(spark)))


def raw_edges(spark: SparkSession, sf: str) -> DataFrame:
    """``source_id, target_id`` of all edges as they lie, for counting."""
    return _run(spark, sf, EDGES_SQL).select("source_id", "target_id")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, DOCS_SQL)


def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, PATHS_SQL)


def page_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as documents: links are dependencies, the last path element is related to.

    The relation's target exists for even page ids and does not for odd ones.
    """
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    named = F.substring_index("path", "/", -1)
    none = F.array().cast("array<string>")
    component = F.struct(
        named.alias("name"), F.lit("page").alias("type"), F.lit("").alias("description"),
        F.lit("public").alias("visibility"),
        F.transform(links, lambda h: F.concat(F.substr(h, F.lit(2)), F.lit(".x"))).alias("dependencies"),
        none.alias("notable_features"),
    )
    relation = F.struct(
        F.lit("page").alias("from"),
        F.when(F.col("page_id") % 2 == 0, named).otherwise(F.concat(F.lit("x"), named)).alias("to"),
        F.element_at(
            F.array(F.lit("Instantiates"), F.lit(" method call "), F.lit("Reuses it")),
            (F.col("page_id") % 3 + 1).cast("int"),
        ).alias("type"),
    )
    return page_paths(spark, sf).select(
        F.concat(F.lit("d"), "page_id").alias("id"), "path",
        F.array(component).cast(COMPONENTS).alias("components"),
        F.array(relation).cast(RELATIONS).alias("relations"),
    )


def method_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as documents with methods; at most 15 distinct methods exist. A directory
    is a nation in a block of 600 customers, so there are more of them in larger tables."""
    methods = _run(spark, sf, METHODS_SQL).groupBy("o_custkey").agg(
        F.array_sort(F.collect_set(F.lower("method"))).alias("methods")
    )
    customer = table(spark, sf, "customer")
    return customer.join(methods, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey", F.lit("/"), F.floor(F.col("c_custkey") / 600)).alias("dir"),
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("has_struct"),
        F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY").alias("has_interface"),
        F.coalesce("methods", F.array().cast("array<string>")).alias("methods"),
    )


def analysis_responses(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON answer per order line. Returned lines leave the components out; every
    seventh order's answers are cut off."""
    part = F.concat(F.lit("part"), "l_partkey")
    supp = F.concat(F.lit("supp"), "l_suppkey")

    def component(name, kind, deps):
        return F.struct(
            name.alias("name"), F.lit(kind).alias("type"), F.lit("").alias("description"),
            F.lit("public").alias("visibility"), deps.alias("dependencies"),
            F.array().cast("array<string>").alias("notable_features"),
        )

    def relation(a, b, kind):
        return F.struct(a.alias("from"), b.alias("to"), F.lit(kind).alias("type"))

    deps = F.array(F.concat(F.lit("pkg"), F.col("l_suppkey") % 5, F.lit(".Fn")))
    none = F.array().cast("array<string>")
    answer = F.to_json(F.struct(
        F.concat(F.lit("Ships on "), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("purpose"),
        F.when(
            F.col("l_returnflag") != "R",
            F.array(component(part, "struct", deps), component(supp, "interface", none)),
        ).alias("components"),
        F.array(
            relation(part, supp, "usage"), relation(supp, part, "association"),
            relation(part, part, "containment"),
        ).alias("relationships"),
        F.array("l_returnflag", "l_linestatus").alias("insights"),
    ))
    path = F.concat_ws("/", F.lit("o"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return spread(table(spark, sf, "lineitem"), cores(spark)).select(
        path.alias("path"),
        F.when(F.col("l_orderkey") % 7 == 0, F.left(answer, F.length(answer) - 3)).otherwise(answer).alias("response"),
    )


# The comparison SQL starts from the same lines.
ANSWERS = """
select concat_ws('/', 'o', l_orderkey, l_linenumber, l_partkey, l_suppkey) as path,
       l_orderkey % 7 <> 0 as ok, concat('Ships on ', strftime(l_shipdate, '%Y-%m-%d')) as purpose,
       concat('part', l_partkey) as part, concat('supp', l_suppkey) as supp,
       concat('pkg', l_suppkey % 5, '.Fn') as dep, l_returnflag, l_linestatus
from lineitem"""


def enhanced_responses(spark: SparkSession, sf: str) -> DataFrame:
    """One answer of the second schema per customer."""
    return table(spark, sf, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("path"),
        F.to_json(F.struct(
            F.array(F.lit("layered"), F.col("c_mktsegment")).alias("architectural_patterns"),
            F.create_map(
                F.lit("line_coverage"), F.col("c_acctbal") / 100,
                F.lit("style_score"), (F.col("c_custkey") % 100).cast("double"),
            ).alias("code_quality_metrics"),
            F.array(F.struct(
                F.lit("dead_code").alias("type"), F.col("c_name").alias("description"),
                F.element_at(
                    F.array(*[F.lit(x) for x in ("High", "medium", "LOW", "other")]),
                    (F.col("c_custkey") % 4 + 1).cast("int"),
                ).alias("impact"),
                F.array(F.concat(F.lit("n/"), "c_nationkey")).alias("components"),
            )).alias("insights"),
            F.create_map(
                F.concat(F.lit("c/"), "c_custkey"), F.array(F.concat(F.lit("n"), "c_nationkey"))
            ).alias("cross_references"),
        )).alias("response"),
    )


def enhanced_responses_in_any_case(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of the second schema with field names in other letter cases, and with keys in
    their maps that differ from field names, and from each other, in case only. Every third
    one is written as the schema has it; every fifth has a text in place of a list."""
    impact = F.element_at(F.array(*[F.lit(x) for x in ("High", "medium", "LOW", "other")]), (F.col("c_custkey") % 4 + 1).cast("int"))

    def answer(patterns, metrics, insights, refs, kind, level, more_metrics, more_refs):
        return F.to_json(F.struct(
            F.array("c_mktsegment").alias(patterns),
            F.create_map(F.lit("Impact"), F.col("c_nationkey").cast("string"), F.lit("impact"), (F.col("c_custkey") % 100).cast("string"), *more_metrics).alias(metrics),
            F.array(F.struct(F.lit("dead_code").alias(kind), F.col("c_name").alias("Description"), impact.alias(level))).alias(insights),
            F.create_map(F.lit("Components"), F.array(F.concat(F.lit("n"), "c_nationkey")), *more_refs).alias(refs),
        ))

    third = answer(
        "architectural_patterns", "code_quality_metrics", "insights", "cross_references", "type", "impact",
        [F.lit("Type"), F.lit("x"), F.lit("line"), F.lit("2.0")], [F.lit("components"), F.array().cast("array<string>")],
    )
    other = answer("Architectural_Patterns", "CODE_QUALITY_METRICS", "Insights", "cross_References", "Type", "IMPACT", [], [])
    text = F.when(F.col("c_custkey") % 3 == 0, third).otherwise(other)
    broken = F.regexp_replace(text, r'(?i)"(architectural_patterns)":\[("[^"]*")\]', '"$1":$2')
    return table(spark, sf, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("path"), F.when(F.col("c_custkey") % 5 == 0, broken).otherwise(text).alias("response")
    )


def _buckets(spark: SparkSession, sf: str) -> int:
    """Of the saved edges, and of their documents, so that they lie alike."""
    return keyed.pieces(table(spark, sf, "lineitem"), 8)


def saved_references(spark: SparkSession, sf: str) -> tuple[keyed.KeyedTable, keyed.KeyedTable]:
    """The edges in two saves, the first two lines of an order before the others, in the
    tables by source and by target."""
    seen = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("last_seen")
    # As the files lie: a save reads its batch several times, and dealing rows out first would
    # be a shuffle for each time.
    lines = _run(spark, sf, EDGES_SQL).select("source_id", "target_id", relation_type("raw_type").alias("type"), seen, seen.alias("seq"), "l_linenumber")
    schema, folder = lines.drop("seq", "l_linenumber").schema, new_folder(spark, "references")
    buckets = _buckets(spark, sf)
    saved = tuple(
        keyed.KeyedTable(f"{folder}/{by}", schema, ("source_id", "target_id", "type"), by, buckets) for by in ("source_id", "target_id")
    )
    for later in (False, True):
        batch = lines.where((F.col("l_linenumber") > 2) == later).drop("l_linenumber")
        for table_ in saved:
            keyed.save(batch, table_)
    return saved


def saved_documents(spark: SparkSession, sf: str) -> keyed.KeyedTable:
    docs = documents(spark, sf)
    saved = keyed.KeyedTable(new_folder(spark, "documents"), docs.schema, ("id",), "id", _buckets(spark, sf))
    keyed.save(docs.withColumn("seq", F.lit(0)), saved)
    return saved


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """``path, pos, target``: two references per file."""
    return files(spark, sf).select("path", F.posexplode(F.array(
        F.concat(F.lit("t"), F.col("doc_id") % 4), F.concat(F.lit("t"), F.col("doc_id") % 3)
    )).alias("pos", "target"))


def file_analyses(spark: SparkSession, sf: str) -> DataFrame:
    """``path, purpose, targets``: the whole text as purpose, empty for every fifth document."""
    return files(spark, sf).select(
        "path",
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("content")).alias("purpose"),
        F.array(
            F.concat(F.lit("t"), F.col("doc_id") % 4), F.concat(F.lit("t"), F.col("doc_id") % 3)
        ).alias("targets"),
    )


ANALYSES = """
select path, case when doc_id % 5 = 0 then '' else content end as purpose,
       concat('t', doc_id % 4) as t0, concat('t', doc_id % 3) as t1 from f"""
REFS = """
select path, 0 as pos, concat('t', doc_id % 4) as target from f
union all select path, 1, concat('t', doc_id % 3) from f"""


# Path expressions of the comparison SQL, for relative paths without empty elements.
def sql_dir(x: str) -> str:
    return f"(case when {x} like '%/%' then regexp_replace({x}, '/[^/]*$', '') else '.' end)"


def sql_base(x: str) -> str:
    return f"regexp_extract({x}, '[^/]*$')"


def sql_slug(x: str) -> str:
    bare = f"regexp_replace({sql_base(x)}, '[.]go$', '')"
    return f"lower(regexp_replace(replace({bare}, ' ', '-'), '[^A-Za-z0-9_-]', '_', 'g'))"


def sql_component_url(path: str, name: str) -> str:
    folder = f"(case when {path} like '%/%' then {sql_slug(sql_dir(path))} || '/' else '' end)"
    return f"'components/' || {folder} || {sql_slug(name)} || '.html'"


def sql_relation_type(x: str) -> str:
    """The labels the edges above use; ``reuses it`` holds ``uses``."""
    return f"(case lower(trim({x})) when 'instantiates' then 'creates' when 'method call' then 'calls' else 'uses' end)"


def sql_key(source: str, target: str, kind: str) -> str:
    return f"substr(sha256({source} || ':' || {target} || ':' || {kind}), 1, 32)"


def sql_parts(
    page: str, line: str, order: str, source: str, out: str, sep: str = "''", text: str | None = None
) -> str:
    """Ordered lines of a page cut into parts by the bytes before them."""
    return f"""
select {page}, part, string_agg({text or line}, {sep} order by {order}) as {out}
from (select *, coalesce(sum(strlen({line}) + 1) over (partition by {page} order by {order}
        rows between unbounded preceding and 1 preceding), 0)::bigint // {PART_BYTES} as part from {source})
group by {page}, part"""
