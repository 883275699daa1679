"""Path, id and URL columns.

Every function takes columns (or column names) and returns a column built from
JVM expressions only, and names its input as few times as it can: these functions nest,
and every mention multiplies the plan. A regular-expression guard keeps the interpreted
fold of ``clean_path`` away from paths that are already clean, which is nearly all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def walk_key(path: Column | str) -> Column:
    """Sort key of a directory walk: names are compared per directory level."""
    return F.translate(as_col(path), "/", "\x01")


def file_ext(path: Column | str) -> Column:
    """Text from the last dot of the last path element, else empty."""
    return F.regexp_extract(as_col(path), r"(\.[^./]*)\z", 1)


def base_name(path: Column | str) -> Column:
    """Last path element; ``.`` for an empty path, ``/`` for slashes only."""
    named = F.regexp_replace(as_col(path), r"^\z", ".")
    last = F.regexp_replace(named, r"^[\s\S]*/(?=[^/]+/*\z)|(?<=[^/])/+\z", "")
    return F.regexp_replace(last, r"^/+\z", "/")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once and named once in the plan."""
    return F.get(F.transform(F.array(value), body), 0)


def _resolved(path: Column) -> Column:
    """Names of a path with ``.``, ``..`` and empty elements resolved, and its root."""
    rooted = path.startswith("/")

    def step(kept: Column, s: Column) -> Column:
        previous = F.get(kept, F.size(kept) - 1)
        return (
            F.when(s != "..", F.concat(kept, F.array(s)))
            .when(previous != "..", F.slice(kept, F.lit(1), F.size(kept) - 1))
            .when(rooted, kept)
            .otherwise(F.concat(kept, F.array(s)))
        )

    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    return F.aggregate(parts, F.array().cast("array<string>"), step)


def clean_path(path: Column | str) -> Column:
    """Shortest equal path: no empty, ``.`` or resolvable ``..`` element."""
    p = as_col(path)
    unclean = p.rlike(r"^\z|//|(^|/)\.\.?(/|\z)|[^/]/\z")

    def fold(raw: Column) -> Column:
        root = F.when(raw.startswith("/"), "/").otherwise("")
        joined = F.concat(root, F.array_join(_resolved(raw), "/"))
        return F.regexp_replace(joined, r"^\z", ".")

    return F.when(unclean, _let(p, fold)).otherwise(p)


def dir_name(path: Column | str) -> Column:
    """Cleaned path without its last element; ``.`` if nothing is left."""
    above = F.regexp_replace(as_col(path), r"^[^/]*\z", "./x")
    return clean_path(F.regexp_replace(above, r"(?<=[\s\S])/[^/]*\z|(?<=^/)[^/]*\z", ""))


def join_path(*parts: Column | str) -> Column:
    """Non-empty parts joined by ``/`` and cleaned; empty if all parts are empty."""
    joined = F.concat_ws("/", *[F.nullif(as_col(p), F.lit("")) for p in parts])
    return F.when(joined == "", "").otherwise(clean_path(joined))


def rel_path(base: Column | str, target: Column | str) -> Column:
    """Path from ``base`` to ``target``; ``target`` itself if there is none."""
    return F.coalesce(rel_path_or_null(base, target), as_col(target))


def rel_path_or_null(base: Column | str, target: Column | str) -> Column:
    """Path from ``base`` to ``target``; null where names alone cannot tell it."""
    sides = F.struct(as_col(base).alias("base"), as_col(target).alias("target"))

    def steps(s: Column) -> Column:
        b, t = s["b"], s["t"]
        differ = F.array_position(F.zip_with(b, t, lambda x, y: x.eqNullSafe(y)), False).cast("int")
        return _let(
            F.when(differ == 0, F.size(b)).otherwise(differ - 1),
            lambda shared: F.when(
                ~F.array_contains(F.slice(b, shared + 1, F.size(b)), ".."),
                F.array_join(F.concat(
                    F.array_repeat(F.lit(".."), F.size(b) - shared), F.slice(t, shared + 1, F.size(t))
                ), "/"),
            ),
        )

    def between(s: Column) -> Column:
        same_root = s["base"].startswith("/") == s["target"].startswith("/")
        names = F.struct(_resolved(s["base"]).alias("b"), _resolved(s["target"]).alias("t"))
        return F.when(same_root, F.regexp_replace(_let(names, steps), r"^\z", "."))

    return _let(sides, between)


def document_id(path: Column | str) -> Column:
    return F.substring(F.sha2(as_col(path), 256), 1, 16)


def package_id(path: Column | str) -> Column:
    """Id from parent directory name and file name only (equal names collide)."""
    parent = base_name(dir_name(path))
    owner = F.when(parent == ".", "main").otherwise(parent)
    return F.substring(F.sha2(F.concat(owner, F.lit(":"), base_name(path)), 256), 1, 16)


def sanitize_path(path: Column | str) -> Column:
    """Drop one leading slash and every ``.`` and ``..`` element (no resolving)."""
    bare = F.regexp_replace(as_col(path), "^/", "")
    return F.array_join(F.filter(F.split(bare, "/"), lambda s: ~s.isin(".", "..")), "/")


def path_to_url(path: Column | str) -> Column:
    p = F.regexp_replace(as_col(path), "^/", "")
    return F.when(p.rlike(r"(^|/)index\.html/*\z"), dir_name(p)).otherwise(F.concat(p, F.lit(".html")))


def up_levels(path: Column | str) -> Column:
    """``../`` once per directory level above a sanitised path."""
    parent = F.regexp_replace(dir_name(sanitize_path(path)), r"^\.\z", "")
    return F.regexp_replace(F.regexp_replace(parent, r"^/\z", "//"), r"[^/]+(/|\z)|/", "../")


def relative_url(from_path: Column | str, to_path: Column | str) -> Column:
    return F.concat(up_levels(from_path), path_to_url(sanitize_path(to_path)))


def slug(path: Column | str) -> Column:
    name = F.regexp_replace(base_name(path), r"\.go\z", "")
    safe = F.regexp_replace(F.translate(name, " ", "-"), "[^A-Za-z0-9_-]", "_")
    return F.lower(safe)


def component_url(path: Column | str, name: Column | str) -> Column:
    package = dir_name(path)
    folder = F.when(package == ".", "").otherwise(F.concat(slug(package), F.lit("/")))
    return F.concat(F.lit("components/"), folder, slug(name), F.lit(".html"))


def component_link(path: Column | str) -> Column:
    return F.concat(F.lit("/components/"), F.translate(as_col(path), "/", "-"), F.lit(".html"))
