"""Page bodies in Markdown.

A page is rows ``out_path, title, part, body_md, last_updated``: parts of bounded size,
numbered from 0, which joined in order are the page. Most pages have one part; an index over everything,
or a hub that most edges point to, has as many as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.formats import format_type, impact_class, metric_band, metric_text
from sourceloom.functions.paths import (
    component_link,
    component_url,
    dir_name,
    path_to_url,
    sanitize_path,
    slug,
    up_levels,
)
from sourceloom.operators.project import file_components, package_of
from sourceloom.sources import store
from sourceloom.operators.skew import DEFAULT, PART_BYTES, SkewPolicy, fixed_rows, text_parts

PAGE_COLUMNS = ["out_path", "title", "part", "body_md", "last_updated"]


def _stamp(at: Column | str | None) -> Column:
    return F.lit(at).cast("timestamp").alias("last_updated")


def module_pages(
    docs: DataFrame, refs: DataFrame, doc_type: str | None = None,
    part_bytes: int = PART_BYTES, policy: SkewPolicy = DEFAULT, by_target: DataFrame | None = None,
    raw: DataFrame | None = None,
) -> DataFrame:
    """Content, then links to what a document depends on and to what uses it.

    ``docs`` has ``id, path, content`` and may have ``type, updated_at``; ``refs`` distinct
    ``source_id, target_id, type``. With ``doc_type`` only documents of that type get a
    page; links may lead to any. Edges to unknown documents give no link. Only narrow link rows are ranked; the content
    meets part 0 in one join on (page, part), where a page of many parts is no hot key.
    ``by_target`` may give the same references stored by target, and ``refs`` by source
    (``sources.keyed``): then an edge meets its far end where it lies, and only the link rows
    are dealt, once, by page. ``raw`` may give ``source_id, target_id`` rows, at least as many
    as ``refs`` and cheaper to count, as before duplicates are dropped.
    """
    clean = sanitize_path("path")
    shown = docs if doc_type is None else docs.where(F.col("type") == doc_type)
    stamp = _stamp(F.col("updated_at") if "updated_at" in docs.columns else None)
    page = shown.select(
        F.col("id").alias("page_id"), up_levels("path").alias("up"), clean.alias("title"), stamp
    )
    far = docs.select(
        F.col("id").alias("far_id"), F.col("path").alias("far_path"), path_to_url(clean).alias("far_url")
    )
    ends = refs.select("type", F.explode(F.array(
        F.struct(F.lit(1).alias("section"), F.col("source_id").alias("page_id"), F.col("target_id").alias("far_id")),
        F.struct(F.lit(2).alias("section"), F.col("target_id").alias("page_id"), F.col("source_id").alias("far_id")),
    )).alias("end")).select("end.*", "type")
    if by_target is None:
        reached = ends.join(far, ["far_id"], "inner")
    else:
        end = lambda rows, n, here, there: rows.select(
            F.lit(n).alias("section"), F.col(here).alias("page_id"), F.col(there).alias("far_id"), "type").join(far, ["far_id"], "inner")
        reached = end(by_target, 1, "source_id", "target_id").unionByName(end(refs, 2, "target_id", "source_id"))
    links = reached.join(page, ["page_id"], "inner")
    link = F.concat(F.lit("- ["), "far_path", F.lit("]("), "up", "far_url", F.lit(")\n"))
    lines = links.select(
        "page_id", "title", "last_updated", "section", "far_id", "type", link.alias("line")
    )
    heading = F.when(F.col("section") == 1, "\n\n## Dependencies\n\n").otherwise("\n\n## Used By\n\n")
    counted = ends.select("page_id") if raw is None else raw.select(F.explode(F.array("source_id", "target_id")).alias("page_id"))
    parts = text_parts(
        lines, ["page_id"], ["section", "far_id", "type"], out="links",
        keep=("title", "last_updated"), heading=heading, sized=counted, part_bytes=part_bytes, policy=policy,
    )
    first = shown.select(
        F.col("id").alias("page_id"), F.lit(0).cast("bigint").alias("part"),
        clean.alias("page_title"), F.coalesce("content", F.lit("")).alias("content"),
        stamp.alias("page_updated"),
    )
    title = F.coalesce("page_title", "title")
    body = F.concat(F.coalesce("content", F.lit("")), F.coalesce("links", F.lit("")))
    return first.join(parts, ["page_id", "part"], "full").select(
        F.concat(title, F.lit(".html")).alias("out_path"), title.alias("title"), "part",
        body.alias("body_md"), F.coalesce("page_updated", "last_updated").alias("last_updated"),
    )


def overview(docs: DataFrame) -> DataFrame:
    """One row: content of the first architecture document by id, else empty."""
    first = docs.where("type = 'architecture'").agg(F.min_by("content", "id").alias("c"))
    return first.select(F.coalesce("c", F.lit("")).alias("overview"))


def index_page(
    comps: DataFrame, at: Column | str | None = None,
    part_bytes: int = PART_BYTES, policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """List of components (``path, name, description``) by package."""
    owned = comps.withColumn("package", package_of("path"))
    url = component_url("path", "name")
    entry = F.concat(F.lit("- ["), "name", F.lit("]("), url, F.lit(") - "), F.coalesce("description", F.lit("")), F.lit("\n"))
    entries = owned.select(
        F.lit(1).alias("place"), "package", F.lit(1).alias("kind"), "name", "path", entry.alias("line")
    )
    blank = F.lit("")
    packages = owned.select("package").distinct()
    title = F.when(F.col("package") == "root", "### Root Package\n\n").otherwise(
        F.concat(F.lit("### Package "), "package", F.lit("\n\n"))
    )
    heads = packages.select(F.lit(1).alias("place"), "package", F.lit(0).alias("kind"), blank.alias("name"), blank.alias("path"), title.alias("line"))
    tails = packages.select(F.lit(1).alias("place"), "package", F.lit(2).alias("kind"), blank.alias("name"), blank.alias("path"), F.lit("\n").alias("line"))
    top = owned.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).alias("place"), blank.alias("package"), F.lit(0).alias("kind"),
        blank.alias("name"), blank.alias("path"),
        F.concat(
            F.lit("# Project Documentation\n\n"), F.when(F.col("n") > 0, "## Components\n\n").otherwise("")
        ).alias("line"),
    )
    lines = top.unionByName(heads).unionByName(entries).unionByName(tails).withColumn(
        "out_path", F.lit("index.html")
    )
    return text_parts(
        lines, ["out_path"], ["place", "package", "kind", "name", "path"],
        part_bytes=part_bytes, policy=policy,
    ).select("out_path", F.lit("Overview").alias("title"), "part", "body_md", _stamp(at))


def component_pages(
    comps: DataFrame, files: DataFrame, references: DataFrame, at: Column | str | None = None,
    part_bytes: int = PART_BYTES, policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """Title, type, overview, package, files and dependencies of each component.

    ``comps``: ``path, name, type, description``; ``files``: ``path, pos, file``;
    ``references``: ``path, pos, target``. A dependency links to the first component of
    that name, else to its own slug. ``collision`` is true where components share a page.
    """
    package = dir_name("path")
    named = comps.select("path", "name", component_url("path", "name").alias("out_path"))
    first_named = named.groupBy("name").agg(F.min_by("out_path", "path").alias("target_url"))
    shared = named.groupBy("out_path").agg((F.count(F.lit(1)) > 1).alias("collision"))
    text = F.concat(
        F.lit("# "), "name", F.lit("\n\n**Type:** "), "type", F.lit("\n\n"),
        F.when(
            F.coalesce("description", F.lit("")) != "",
            F.concat(F.lit("## Overview\n\n"), "description", F.lit("\n\n")),
        ).otherwise(""),
        F.lit("## Package\n\n"),
        F.when(package == ".", "Root package\n\n").otherwise(
            F.concat(F.lit("Package `"), package, F.lit("`\n\n"))
        ),
        F.lit("## Files\n\n"),
    )

    def line(rows: DataFrame, section: int, pos: Column, value: Column) -> DataFrame:
        return rows.select("path", F.lit(section).alias("section"), pos.cast("bigint").alias("pos"), value.alias("line"))

    zero = F.lit(0)
    file_lines = line(files, 1, F.col("pos"), F.concat(F.lit("- `"), "file", F.lit("`\n")))
    files_end = line(comps, 2, zero, F.lit("\n"))
    linked = references.join(first_named.withColumnRenamed("name", "target"), ["target"], "left")
    url = F.coalesce("target_url", F.concat(F.lit("components/"), slug("target"), F.lit(".html")))
    dep_lines = line(linked, 4, F.col("pos"), F.concat(F.lit("- ["), "target", F.lit("]("), url, F.lit(")\n")))
    having = references.select("path").distinct()
    dep_head = line(having, 3, zero, F.lit("## Dependencies\n\n"))
    dep_end = line(having, 5, zero, F.lit("\n"))
    lines = file_lines.unionByName(files_end).unionByName(dep_head).unionByName(dep_lines).unionByName(dep_end)
    head = named.join(shared, ["out_path"], "inner")
    lines = lines.join(head, ["path"], "inner")
    narrow = references.select("path")
    parts = text_parts(
        lines, ["path"], ["section", "pos"], out="rest", keep=("name", "out_path", "collision"),
        sized=files.select("path").unionByName(comps.select("path")).unionByName(narrow).unionByName(narrow).unionByName(narrow),
        part_bytes=part_bytes, policy=policy,
    )
    first = comps.select("path", F.lit(0).cast("bigint").alias("part"), text.alias("text"))
    body = F.concat(F.coalesce("text", F.lit("")), "rest")
    return parts.join(first, ["path", "part"], "left").select(
        "path", "out_path", F.col("name").alias("title"), "part", body.alias("body_md"), _stamp(at),
        "collision",
    )


def documentation_pages(
    analyses: DataFrame, references: DataFrame, at: Column | str | None = None,
    part_bytes: int = PART_BYTES, policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """Index and component pages of analysed files: ``path, content`` and their
    references ``path, pos, target``."""
    comps = file_components(analyses)
    no_files = comps.where(F.lit(False)).select("path", F.lit(0).alias("pos"), F.col("path").alias("file"))
    pages = component_pages(comps, no_files, references, at, part_bytes, policy)
    return index_page(comps, at, part_bytes, policy).unionByName(pages.select(*PAGE_COLUMNS))


def wiki_pages(
    docs: DataFrame, refs: DataFrame, at: Column | str | None = None,
    part_bytes: int = PART_BYTES, policy: SkewPolicy = DEFAULT, raw: DataFrame | None = None,
) -> DataFrame:
    """Home and architecture page, a page per module, and the search page.

    Home shows the first architecture document by id; the architecture page exists only
    if there is one.
    """
    changed = F.col("updated_at") if "updated_at" in docs.columns else F.lit(None)
    first = docs.where("type = 'architecture'").agg(
        F.min_by(F.struct("content", changed.cast("timestamp").alias("at")), "id").alias("doc")
    )
    text = F.coalesce("doc.content", F.lit(""))

    def page(path: str, title: str, body: Column, stamp: Column) -> Column:
        return F.struct(
            F.lit(path).alias("out_path"), F.lit(title).alias("title"),
            F.lit(0).cast("bigint").alias("part"), body.alias("body_md"), stamp.alias("last_updated"),
        )

    now = _stamp(at)
    fixed = first.select(F.explode(F.array(
        page("index.html", "Home", text, now),
        page("architecture.html", "Architecture", F.when(F.isnotnull("doc"), text), F.col("doc.at")),
        page("search.html", "Search", F.lit(""), now),
    )).alias("page")).select("page.*").where(F.isnotnull("body_md"))
    return fixed.unionByName(module_pages(docs, refs, "module", part_bytes, policy, raw=raw))




def diagram(
    nodes: DataFrame, edges: DataFrame, part_bytes: int = PART_BYTES, policy: SkewPolicy = DEFAULT, raw: DataFrame | None = None
) -> DataFrame:
    """Diagram text in parts: nodes ``path, name``, then edges ``source, target, type``.
    ``raw`` may give rows, at least as many as ``edges`` and cheaper to count."""
    def ident(c: str) -> Column:
        return F.translate(c, "/", "_")

    blank = F.lit("")
    head = fixed_rows(
        nodes.sparkSession, ["kind", "k1", "k2", "k3", "line"],
        [(0, "", "", "", "```mermaid\ngraph TD\n"), (3, "", "", "", "```")],
    )
    node_lines = nodes.select(
        F.lit(1).alias("kind"), F.col("path").alias("k1"), F.col("name").alias("k2"), blank.alias("k3"),
        F.concat(F.lit("  "), ident("path"), F.lit("["), "name", F.lit("]\n")).alias("line"),
    )
    edge_lines = edges.select(
        F.lit(2).alias("kind"), F.col("source").alias("k1"), F.col("target").alias("k2"), F.col("type").alias("k3"),
        F.concat(
            F.lit("  "), ident("source"), F.lit(" --> |"), "type", F.lit("| "), ident("target"), F.lit("\n")
        ).alias("line"),
    )
    lines = head.unionByName(node_lines).unionByName(edge_lines)
    frame = nodes.sparkSession.range(2)  # as many lines as the head has
    narrow = [x.select(F.lit(1).alias("one")) for x in (frame, nodes, edges if raw is None else raw)]
    return text_parts(
        lines, [], ["kind", "k1", "k2", "k3"], out="diagram", part_bytes=part_bytes, policy=policy,
        sized=narrow[0].unionByName(narrow[1]).unionByName(narrow[2]),
    )


def metric_rows(enhanced: DataFrame) -> DataFrame:
    """Metrics of each ``path, analysis`` as display rows."""
    rows = enhanced.select("path", F.explode("analysis.code_quality_metrics").alias("key", "raw"))
    value = F.try_cast("raw", "double") if hasattr(F, "try_cast") else F.expr("try_cast(raw as double)")
    return rows.withColumn("value", value).select(
        "path", "key", format_type("key").alias("label"), metric_band("value").alias("band"),
        metric_text("value").alias("value_text"),
    )


def insight_rows(enhanced: DataFrame) -> DataFrame:
    """Insights as display rows: label, class of the impact, linked components."""
    rows = enhanced.select("path", F.posexplode("analysis.insights").alias("pos", "i"))
    names = F.coalesce("i.components", F.array().cast("array<string>"))
    return rows.select(
        "path", "pos", format_type("i.type").alias("label"), F.col("i.impact").alias("impact"),
        impact_class("i.impact").alias("impact_class"), F.col("i.description").alias("description"),
        F.transform(names, lambda c: F.struct(c.alias("name"), component_link(c).alias("url"))).alias("components"),
    )


def cross_reference_rows(enhanced: DataFrame) -> DataFrame:
    """Direct dependencies: the keys of the cross-reference map."""
    return enhanced.select(
        "path", F.explode(F.map_keys("analysis.cross_references")).alias("target")
    ).withColumn("url", component_link("target"))


def write_pages(pages: DataFrame, path: str) -> int:
    """Pages as Parquet, the next version of a table; returns its number.

    Parts are dealt by page and part, so a large page is no task's burden and nothing is
    computed twice to find ranges. A second run adds a version and leaves the first one.
    """
    dealt = pages.repartition("out_path", "part").sortWithinPartitions("out_path", "part")
    return store.write_version(dealt, path)


def read_pages(spark, path: str) -> DataFrame:
    """Pages of the last finished version, in parts."""
    return store.read_table(spark, path)


def whole_pages(pages: DataFrame, max_bytes: int = 64 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """Pages with one body each where it has at most ``max_bytes``, and the parts of the rest.

    The size is summed by page before bodies move, so no task gathers a larger page.
    """
    rest = [c for c in pages.columns if c not in ("part", "body_md")]
    size = pages.groupBy("out_path").agg(F.sum(F.octet_length("body_md")).alias("__bytes"))
    sized = pages.join(size, "out_path")
    items = F.sort_array(F.collect_list(F.struct("part", "body_md")))
    whole = sized.where(F.col("__bytes") <= max_bytes).groupBy(*rest).agg(F.array_join(items["body_md"], "").alias("body_md"))
    return whole, sized.where(F.col("__bytes") > max_bytes).select(*pages.columns)
