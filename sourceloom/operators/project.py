"""Files rolled up to components and to a project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.paths import as_col, base_name, dir_name, rel_path_or_null, walk_key
from sourceloom.operators.skew import DEFAULT, PART_BYTES, SkewPolicy, text_parts, with_rank

# Path suffix -> project type, and path suffix -> display language.
PROJECT_SUFFIXES = {"go.mod": "go-module", ".sln": "dotnet-solution"}
LANGUAGE_SUFFIXES = {".go": "Go", ".cs": "C#", ".js": "JavaScript", ".py": "Python"}


def _by_suffix(path: Column, table: dict[str, str]) -> Column:
    first, *rest = table.items()
    return reduce(
        lambda chain, kv: chain.when(F.endswith(path, F.lit(kv[0])), kv[1]),
        rest,
        F.when(F.endswith(path, F.lit(first[0])), first[1]),
    )


def _first(value: Column, order: Column) -> Column:
    """First non-null value in order, ``unknown`` if there is none."""
    return F.coalesce(F.min_by(value, F.when(value.isNotNull(), order)), F.lit("unknown"))


def project_type(files: DataFrame, walk_order: bool = True) -> DataFrame:
    """One row: type given by the first marker file, in walk order or in path order."""
    path = F.col("path")
    order = walk_key(path) if walk_order else path
    return files.agg(_first(_by_suffix(path, PROJECT_SUFFIXES), order).alias("project_type"))


def main_language(files: DataFrame) -> DataFrame:
    """One row: the most frequent language, smallest name on a tie."""
    counts = files.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("language", F.struct(-F.col("n"), F.col("language")))
    return counts.agg(F.coalesce(best, F.lit("unknown")).alias("language"))


def display_language(files: DataFrame) -> DataFrame:
    """One row: language of the first path (string order) with a known suffix."""
    path = F.col("path")
    return files.agg(_first(_by_suffix(path, LANGUAGE_SUFFIXES), path).alias("language"))


def component_type(language: Column | str, path: Column | str) -> Column:
    return (
        F.when(as_col(language) == "go", "package")
        .when(F.endswith(as_col(path), F.lit(".csproj")), "project")
        .otherwise("unknown")
    )


def with_component(files: DataFrame, root: str) -> DataFrame:
    """Add ``comp_path``: the directory below root, or a project file itself.

    Files with no path relative to the root are left out.
    """
    base = root.rstrip("/") or "/"
    below = F.lit(base if base == "/" else base + "/")
    rel = F.when(
        F.startswith(F.col("path"), below), F.substr(F.col("path"), F.length(below) + 1)
    ).otherwise(rel_path_or_null(F.lit(base), F.col("path")))
    return files.withColumn("__rel", rel).where(F.isnotnull("__rel")).withColumn(
        "comp_path",
        F.when(F.endswith(F.col("path"), F.lit(".csproj")), F.col("__rel")).otherwise(
            dir_name("__rel")
        ),
    ).drop("__rel")


def components(files: DataFrame, root: str) -> DataFrame:
    """One row per component, typed by its first file in walk order."""
    first = F.min_by(component_type("language", "path"), walk_key("path"))
    return with_component(files, root).groupBy("comp_path").agg(
        first.alias("type"), F.count(F.lit(1)).alias("n_files")
    ).select("comp_path", "type", base_name("comp_path").alias("name"), "n_files")


def component_files(
    files: DataFrame, root: str, part_bytes: int = PART_BYTES, policy: SkewPolicy = DEFAULT
) -> DataFrame:
    """Files of each component in walk order, as text parts of bounded size."""
    lines = with_component(files.select("path"), root).select(
        "comp_path", walk_key("path").alias("key"), F.col("path").alias("line")
    )
    return text_parts(
        lines, ["comp_path"], ["key"], out="files", sep="\n", sized=lines.select("comp_path"),
        part_bytes=part_bytes, policy=policy,
    )


def component_descriptions(files: DataFrame, analyses: DataFrame, root: str) -> DataFrame:
    """First non-empty purpose per component in walk order, else empty."""
    found = with_component(files.select("path"), root).join(
        analyses.select("path", "purpose"), "path", "left"
    )
    given = F.when(F.col("purpose") != "", walk_key("path"))
    return found.groupBy("comp_path").agg(
        F.coalesce(F.min_by("purpose", given), F.lit("")).alias("description")
    )


def component_references(files: DataFrame, analyses: DataFrame, root: str) -> DataFrame:
    """Distinct relation targets per component with their first place ``(walk key, pos)``.

    The first place is a minimum, so repeats of a target collapse before the shuffle.
    """
    targets = analyses.select("path", F.posexplode("targets").alias("pos", "target"))
    placed = with_component(files.select("path"), root).join(targets, "path")
    first = F.min(F.struct(walk_key("path").alias("key"), F.col("pos")))
    return placed.groupBy("comp_path", "target").agg(first.alias("first")).select(
        "comp_path", "target", F.col("first.key").alias("first_key"), F.col("first.pos").alias("first_pos")
    )


def component_reference_parts(
    references: DataFrame, part_bytes: int = PART_BYTES, policy: SkewPolicy = DEFAULT, raw: DataFrame | None = None
) -> DataFrame:
    """Targets of each component in parts. ``raw`` may give ``comp_path`` rows, group by group
    at least as many as ``references`` and cheaper to count."""
    return text_parts(
        references, ["comp_path"], ["first_key", "first_pos"], line="target", out="references",
        sep=",", sized=raw, part_bytes=part_bytes, policy=policy,
    )


def project(files: DataFrame, analyses: DataFrame, root: str) -> DataFrame:
    """The project as component rows that repeat the project's own fields.

    Those fields are one-row results, read as scalar subqueries: no join is planned.
    """
    references = component_references(files, analyses, root).groupBy("comp_path").agg(
        F.count(F.lit(1)).alias("n_references")
    )
    rolled = components(files, root).join(
        component_descriptions(files, analyses, root), "comp_path"
    ).join(references, "comp_path", "left")
    return rolled.select(
        F.lit(root).alias("root"), main_language(files).scalar().alias("language"),
        project_type(files).scalar().alias("project_type"),
        "comp_path", "type", "name", "n_files", "description",
        F.coalesce("n_references", F.lit(0)).alias("n_references"),
    )


def file_components(analyses: DataFrame) -> DataFrame:
    """Each analysed path as a component of type ``file`` (its references are edge rows)."""
    return analyses.select(
        base_name("path").alias("name"), "path", F.lit("file").alias("type"),
        F.col("content").alias("description"),
    )


def file_component_counts(
    comps: DataFrame, references: DataFrame, policy: SkewPolicy = DEFAULT
) -> DataFrame:
    """Components with the number of their references ``(path, pos, target)``."""
    counts = references.groupBy("path").agg(F.count(F.lit(1)).alias("n_references"))
    return comps.join(counts, "path", "left").select(
        *comps.columns, F.coalesce("n_references", F.lit(0)).alias("n_references")
    )


def package_of(path: Column | str) -> Column:
    package = dir_name(path)
    return F.when(package == ".", "root").otherwise(package)


def by_package(comps: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Components with their package and their place in it by name (then path)."""
    return with_rank(
        comps.withColumn("package", package_of("path")), ["package"], ["name", "path"], "ord", policy=policy
    )
