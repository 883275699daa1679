import posixpath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourceloom.functions import paths as p

CASES = [
    ("", "a", "/", "//", "/a", "a/", "a/b", "/a/b", "a//b", "a/./b", "a/../b", "../a", "../../a/..",
     "/..", "/../a", "a/b/../../..", "./", "a/b/", "a.b/c", "a/.b", ".", "..", "a/b/index.html",
     "index.html", "//x", "a/b.go/", "é/ü.go", "a b/c d.go"),
]


def go_clean(x):
    if x == "":
        return "."
    rooted = x.startswith("/")
    out = []
    for part in x.split("/"):
        if part in ("", "."):
            continue
        if part == "..":
            if out and out[-1] != "..":
                out.pop()
            elif not rooted:
                out.append("..")
        else:
            out.append(part)
    return ("/" if rooted else "") + "/".join(out) or "."


def go_base(x):
    if x == "":
        return "."
    x = x.rstrip("/")
    return x.split("/")[-1] if x else "/"


def go_dir(x):
    return go_clean(x[: x.rfind("/") + 1])


def go_ext(x):
    last = x.split("/")[-1]
    return last[last.rindex("."):] if "." in last else ""


def sanitize(x):
    return "/".join(s for s in x.removeprefix("/").split("/") if s not in (".", ".."))


def to_url(x):
    x = x.removeprefix("/")
    return go_dir(x) if go_base(x) == "index.html" else x + ".html"


def rel_url(a, b):
    d = go_dir(sanitize(a))
    return ("" if d == "." else "../" * len(d.split("/"))) + to_url(sanitize(b))


def check(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "x string").select(
        "x", p.clean_path("x").alias("clean"), p.base_name("x").alias("base"), p.dir_name("x").alias("dir"),
        p.file_ext("x").alias("ext"), p.sanitize_path("x").alias("san"), p.path_to_url("x").alias("url"),
        p.relative_url("x", F.lit("lib/y.go")).alias("rel"),
    ).collect()
    for r in rows:
        assert r.clean == go_clean(r.x), r
        assert r.base == go_base(r.x), r
        assert r.dir == go_dir(r.x), r
        assert r.ext == go_ext(r.x), r
        assert r.san == sanitize(r.x), r
        assert r.url == to_url(r.x), r
        assert r.rel == rel_url(r.x, "lib/y.go"), r


def test_path_cases(spark):
    check(spark, CASES[0])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab./\n", max_size=9), min_size=30, max_size=60))
def test_path_properties(spark, values):
    check(spark, values)


def test_join_and_relative_paths(spark):
    pairs = [("a/b", "a/c"), ("a", "a"), ("/a", "/a/b/c"), ("/a/b", "/c"), (".", "x/y"), ("x", "."),
             ("root", "root/x/y.go"), ("a/b/c", "a/d"), ("", "q")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", p.join_path("a", "b").alias("j"), p.rel_path("a", "b").alias("r")
    ).collect()
    for r in rows:
        assert r.j == go_clean("/".join(x for x in (r.a, r.b) if x)), r
        assert r.r == posixpath.relpath("/" + r.b.lstrip("/"), "/" + r.a.lstrip("/")), r


def test_relative_path_without_answer(one):
    assert one(p.rel_path("a", "b"), a="/x", b="y") == "y"
    assert one(p.rel_path("a", "b"), a="../x", b="y") == "y"


@pytest.mark.parametrize(("fn", "value", "want"), [
    (p.sanitize_path, "/a/./b/../c.go", "a/b/c.go"),
    (p.path_to_url, "/pkg/a.go", "pkg/a.go.html"),
    (p.path_to_url, "docs/index.html", "docs"),
    (p.slug, "dir/My File+1.go", "my-file_1"),
    (p.component_link, "a/b", "/components/a-b.html"),
])
def test_scalars(one, fn, value, want):
    got = one(fn("x"), x=value)
    assert got == want


def test_urls(one):
    assert one(p.relative_url("a", "b"), a="pkg/a/x.go", b="lib/y.go") == "../../lib/y.go.html"
    assert one(p.relative_url("a", "b"), a="x.go", b="y.go") == "y.go.html"
    assert one(p.component_url("a", "b"), a="a/b/X.go", b="X.go") == "components/b/x.html"
    assert one(p.component_url("a", "b"), a="X.go", b="X.go") == "components/x.html"


def test_package_id_collides_by_design(one):
    assert one(p.package_id("x"), x="a/x/f.go") == one(p.package_id("x"), x="b/x/f.go")
    assert one(p.package_id("x"), x="f.go") == one(p.package_id("x"), x="main/f.go")
    assert one(p.document_id("x"), x="a/x/f.go") != one(p.document_id("x"), x="b/x/f.go")


def test_walk_key_orders_like_a_directory_walk(spark):
    names = ["a.go", "a/b.go", "a/b/c.go", "ab.go"]
    got = spark.createDataFrame([(n,) for n in names], "x string").orderBy(p.walk_key("x"))
    assert [r.x for r in got.collect()] == ["a/b/c.go", "a/b.go", "a.go", "ab.go"]
