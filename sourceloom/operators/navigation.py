"""Navigation trees as flat tables.

Columns: ``node_path, parent_path, title, url, depth, ord``. ``ord`` is the place among
the children of one parent; the root has the parent path ``''``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.paths import base_name, component_url, path_to_url, sanitize_path
from sourceloom.operators.project import package_of
from sourceloom.operators.skew import DEFAULT, SkewPolicy, fixed_rows, with_rank

NAV_COLUMNS = ["node_path", "parent_path", "title", "url", "depth", "ord"]


def directory_nav(docs: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Directories and files of document paths below the fixed Home and Search.

    A directory links to its first file by path. The root keeps path order; children are
    sorted by title. Ancestors of equal paths collapse before the shuffle.
    """
    files = docs.select("path", sanitize_path("path").alias("clean")).where("clean != ''")
    files = files.withColumn("url", path_to_url("path")).withColumn("names", F.split("clean", "/"))
    n = F.size("names")
    above = F.when(
        n > 1,
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.array_join(F.slice("names", F.lit(1), i), "/"),
        ),
    )
    folders = files.select("path", "url", F.explode(above).alias("node_path")).groupBy(
        "node_path"
    ).agg(F.min_by("url", "path").alias("url"), F.min("path").alias("first_path"))
    entries = folders.select("node_path", "url", "first_path", F.lit(0).alias("kind")).unionByName(
        files.select(
            F.col("clean").alias("node_path"), "url", F.col("path").alias("first_path"),
            F.lit(1).alias("kind"),
        )
    )
    slashes = F.length("node_path") - F.length(F.translate("node_path", "/", ""))
    parent = F.when(slashes == 0, "").otherwise(F.regexp_replace("node_path", r"/[^/]*\z", ""))
    title = F.substring_index("node_path", "/", -1)
    placed = entries.select(
        "node_path", parent.alias("parent_path"), title.alias("title"), "url",
        slashes.cast("int").alias("depth"), "kind", "first_path",
        F.when(slashes == 0, F.col("first_path")).otherwise(title).alias("sort_key"),
    )
    order = ["sort_key", "kind", "node_path", "first_path"]
    # A path gives a directory one entry at most: itself, or the folder on its way.
    ranked = with_rank(placed, ["parent_path"], order, "ord", policy=policy, bound=docs.select("path")).withColumn(
        "ord", F.col("ord") + F.when(F.col("depth") == 0, 2).otherwise(0)
    )
    fixed = fixed_rows(docs.sparkSession, NAV_COLUMNS, [
        ("index.html", "", "Home", "index.html", 0, 1),
        ("search.html", "", "Search", "search.html", 0, 2),
    ])
    return fixed.unionByName(ranked.select(*NAV_COLUMNS))


def package_nav(comps: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Overview, then Packages with each package and its components by name.

    ``comps`` has ``path, name``. The Packages entry exists only if there are components.
    """
    owned = comps.select("path", "name", package_of("path").alias("package"))
    members = with_rank(owned, ["package"], ["name", "path"], "ord", policy=policy).select(
        F.concat(F.lit("packages/"), "package", F.lit("/"), "path").alias("node_path"),
        F.concat(F.lit("packages/"), "package").alias("parent_path"),
        F.col("name").alias("title"), component_url("path", "name").alias("url"),
        F.lit(2).alias("depth"), "ord",
    )
    packages = with_rank(owned.select("package").distinct(), [], ["package"], "ord", policy=policy).select(
        F.concat(F.lit("packages/"), "package").alias("node_path"),
        F.lit("packages").alias("parent_path"), base_name("package").alias("title"),
        F.lit("").alias("url"), F.lit(1).alias("depth"), "ord",
    )
    top = owned.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        F.lit("packages").alias("node_path"), F.lit("").alias("parent_path"),
        F.lit("Packages").alias("title"), F.lit("").alias("url"),
        F.lit(0).alias("depth"), F.lit(2).alias("ord"),
    )
    overview = fixed_rows(
        comps.sparkSession, NAV_COLUMNS, [("overview", "", "Overview", "index.html", 0, 1)]
    )
    return overview.unionByName(top).unionByName(packages).unionByName(members)


def nav_flags(nav: DataFrame, current_url: str) -> DataFrame:
    """Add ``active`` and ``has_children``. Repeated parents collapse before the shuffle."""
    parents = nav.where("parent_path != ''").select(
        F.col("parent_path").alias("node_path"), F.lit(True).alias("__parent")
    ).distinct()
    return nav.join(parents, "node_path", "left").select(
        *nav.columns, (F.col("url") == current_url).alias("active"),
        F.coalesce("__parent", F.lit(False)).alias("has_children"),
    )
