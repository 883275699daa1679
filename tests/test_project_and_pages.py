import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sourceloom.operators import navigation, pages, project, similarity
from sourceloom.operators.skew import SkewPolicy
from sourceloom.sources.tree import classify_files

FORCED = SkewPolicy(max_rows=2)
POLICIES = [SkewPolicy(), FORCED]
THREE = ["in/main.go", "in/math/calculator.go", "in/math/operations.go"]
MORE = [*THREE, "in/go.mod", "in/A.CS", "in/a.csproj", "in/a.sln", "in/readme.md", "in/noext"]


def files_of(spark, names):
    return classify_files(spark.createDataFrame([(n,) for n in names], "path string"))


def test_project_of_three_files(spark):
    files = files_of(spark, THREE)
    assert project.project_type(files).first().project_type == "unknown"
    assert project.main_language(files).first().language == "go"
    got = {r.comp_path: (r.type, r.name, r.n_files) for r in project.components(files, "in").collect()}
    assert got == {".": ("package", ".", 1), "math": ("package", "math", 2)}


def test_project_of_more_files(spark):
    files = files_of(spark, MORE)
    assert files.count() == 7
    assert project.project_type(files).first().project_type == "dotnet-solution"
    assert project.main_language(files).first().language == "go"
    got = {r.comp_path: (r.type, r.name) for r in project.components(files, "in/").collect()}
    assert got == {".": ("unknown", "."), "a.csproj": ("project", "a.csproj"), "math": ("package", "math")}
    listed = {r.comp_path: r.files for r in project.component_files(files, "in").collect()}
    assert listed["."] == "in/A.CS\nin/a.sln\nin/go.mod\nin/main.go"


def test_project_ties_and_empty(spark):
    files = files_of(spark, ["in/a.go", "in/b.cs", "in/algo.mod"])
    assert project.project_type(files).first().project_type == "go-module"
    tie = files_of(spark, ["in/a.go", "in/b.cs"])
    assert project.main_language(tie).first().language == "csharp"
    none = files.where("false")
    assert project.main_language(none).first().language == "unknown"
    assert project.project_type(none).first().project_type == "unknown"
    assert project.display_language(none).first().language == "unknown"
    mixed = spark.createDataFrame([("b.go",), ("a.py",), ("0.txt",)], "path string")
    assert project.display_language(mixed).first().language == "Python"


def test_rollup(spark):
    files = files_of(spark, THREE)
    analyses = spark.createDataFrame(
        [("in/math/calculator.go", "", ["x", "y", "x"]), ("in/math/operations.go", "ops", ["y", "z"])],
        "path string, purpose string, targets array<string>")
    described = {r.comp_path: r.description for r in project.component_descriptions(files, analyses, "in").collect()}
    assert described == {".": "", "math": "ops"}
    refs = project.component_reference_parts(project.component_references(files, analyses, "in")).collect()
    assert [(r.comp_path, r.references) for r in refs] == [("math", "x,y,z")]
    rows = {r.comp_path: r for r in project.project(files, analyses, "in").collect()}
    assert rows["math"].n_references == 3 and rows["."].n_references == 0
    assert rows["."].language == "go" and rows["."].project_type == "unknown"


def nav_rows(df):
    return {r.node_path: (r.parent_path, r.title, r.url, r.depth, r.ord) for r in df.collect()}


@pytest.mark.parametrize("policy", POLICIES)
def test_directory_nav(spark, policy):
    docs = spark.createDataFrame([("b/z.go",), ("/a.go",), ("b/c/y.go",), ("b/a.go",), ("m.go",)], "path string")
    assert nav_rows(navigation.directory_nav(docs, policy)) == {
        "index.html": ("", "Home", "index.html", 0, 1), "search.html": ("", "Search", "search.html", 0, 2),
        "a.go": ("", "a.go", "a.go.html", 0, 3), "b": ("", "b", "b/a.go.html", 0, 4),
        "m.go": ("", "m.go", "m.go.html", 0, 5), "b/a.go": ("b", "a.go", "b/a.go.html", 1, 1),
        "b/c": ("b", "c", "b/c/y.go.html", 1, 2), "b/z.go": ("b", "z.go", "b/z.go.html", 1, 3),
        "b/c/y.go": ("b/c", "y.go", "b/c/y.go.html", 2, 1),
    }


def test_nav_flags(spark):
    docs = spark.createDataFrame([("b/z.go",), ("a.go",)], "path string")
    flags = {r.node_path: (r.active, r.has_children) for r in
             navigation.nav_flags(navigation.directory_nav(docs), "a.go.html").collect()}
    assert flags["a.go"] == (True, False) and flags["b"] == (False, True) and len(flags) == 5


@pytest.mark.parametrize("policy", POLICIES)
def test_package_nav_and_index(spark, policy):
    comps = spark.createDataFrame(
        [("x/b.go", "b.go", "B"), ("x/a.go", "a.go", "A"), ("m.go", "m.go", None), ("y/x/a.go", "a.go", "A2")],
        "path string, name string, description string")
    got = nav_rows(navigation.package_nav(comps, policy))
    assert got["packages/root"] == ("packages", "root", "", 1, 1)
    assert got["packages/y/x"] == ("packages", "x", "", 1, 3)
    assert got["packages/x/x/b.go"] == ("packages/x", "b.go", "components/x/b.html", 2, 2)
    assert got["packages/root/m.go"][2] == "components/m.html"
    empty = nav_rows(navigation.package_nav(comps.where("false"), policy))
    assert set(empty) == {"overview"}

    rows = pages.index_page(comps, part_bytes=40, policy=policy).orderBy("part").collect()
    assert "".join(r.body_md for r in rows) == (
        "# Project Documentation\n\n## Components\n\n"
        "### Root Package\n\n- [m.go](components/m.html) - \n\n"
        "### Package x\n\n- [a.go](components/x/a.html) - A\n- [b.go](components/x/b.html) - B\n\n"
        "### Package y/x\n\n- [a.go](components/x/a.html) - A2\n\n")
    assert len(rows) > 1
    alone = pages.index_page(comps.where("false")).collect()
    assert [r.body_md for r in alone] == ["# Project Documentation\n\n"]


@pytest.mark.parametrize("policy", POLICIES)
def test_component_pages(spark, policy):
    comps = spark.createDataFrame(
        [("x/a.go", "a.go", "file", "A"), ("y/x/a.go", "a.go", "file", ""), ("m.go", "m.go", "file", "M")],
        "path string, name string, type string, description string")
    files = spark.createDataFrame([("m.go", 0, "f1"), ("m.go", 1, "f2")], "path string, pos int, file string")
    refs = spark.createDataFrame([("m.go", 0, "a.go"), ("m.go", 1, "no such.go")], "path string, pos int, target string")
    rows = {r.path: r for r in pages.component_pages(comps, files, refs, policy=policy).collect()}
    assert rows["m.go"].body_md == (
        "# m.go\n\n**Type:** file\n\n## Overview\n\nM\n\n## Package\n\nRoot package\n\n## Files\n\n- `f1`\n- `f2`\n\n"
        "## Dependencies\n\n- [a.go](components/x/a.html)\n- [no such.go](components/no-such.html)\n\n")
    assert rows["y/x/a.go"].body_md == "# a.go\n\n**Type:** file\n\n## Package\n\nPackage `y/x`\n\n## Files\n\n\n"
    assert rows["x/a.go"].collision and rows["y/x/a.go"].collision and not rows["m.go"].collision
    cut = pages.component_pages(comps, files, refs, part_bytes=8, policy=policy).where("path = 'm.go'").orderBy("part")
    assert "".join(r.body_md for r in cut.collect()) == rows["m.go"].body_md and cut.count() > 2


@pytest.mark.parametrize("policy", POLICIES)
def test_module_pages(spark, policy):
    docs = spark.createDataFrame(
        [("arch1", "architecture.md", "architecture", "# Architecture"), ("mod1", "pkg/example/example.go", "module", "# Example"),
         ("mod2", "/q.go", "module", "Q")], "id string, path string, type string, content string")
    refs = spark.createDataFrame(
        [("mod1", "arch1", "import"), ("mod1", "gone", "import"), ("mod2", "mod1", "uses"), ("mod2", "mod1", "calls")],
        "source_id string, target_id string, type string")
    rows = {r.title: r for r in pages.module_pages(docs, refs, policy=policy).collect()}
    assert rows["pkg/example/example.go"].body_md == (
        "# Example\n\n## Dependencies\n\n- [architecture.md](../../architecture.md.html)\n"
        "\n\n## Used By\n\n- [/q.go](../../q.go.html)\n- [/q.go](../../q.go.html)\n")
    assert rows["architecture.md"].body_md == "# Architecture\n\n## Used By\n\n- [pkg/example/example.go](pkg/example/example.go.html)\n"
    assert rows["q.go"].out_path == "q.go.html" and rows["q.go"].body_md.count("- [pkg") == 2
    cut = pages.module_pages(docs, refs, part_bytes=10, policy=policy).where("title like 'pkg%'").orderBy("part")
    assert "".join(r.body_md for r in cut.collect()) == rows["pkg/example/example.go"].body_md
    alone = {r.title: r.body_md for r in pages.module_pages(docs, refs.where("false"), policy=policy).collect()}
    assert alone["q.go"] == "Q"
    assert pages.overview(docs).first().overview == "# Architecture"
    assert pages.overview(docs.where("false")).first().overview == ""


@pytest.mark.parametrize("policy", POLICIES)
def test_diagram(spark, policy):
    nodes = spark.createDataFrame([("a/b", "B"), ("c", "C")], "path string, name string")
    links = spark.createDataFrame([("a/b", "c", "uses"), ("c", "a/b", "calls")], "source string, target string, type string")
    parts = pages.diagram(nodes, links, part_bytes=16, policy=policy).orderBy("part").collect()
    assert "".join(r.diagram for r in parts) == (
        "```mermaid\ngraph TD\n  a_b[B]\n  c[C]\n  a_b --> |uses| c\n  c --> |calls| a_b\n```")
    assert len(parts) > 1


def test_pages_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a.html", "a", 0, "x"), ("a.html", "a", 1, "y"), ("b.html", "b", 0, "z")],
                                 "out_path string, title string, part long, body_md string")
    pages.write_pages(rows, str(tmp_path / "pages"))
    assert sorted(map(tuple, pages.read_pages(spark, str(tmp_path / "pages")).collect())) == sorted(map(tuple, rows.collect()))


VECTORS = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [2.0, 0.1]), ("d", []), ("e", [1.0]), ("f", [0.0, 0.0]), ("g", [1.0, 0.0])]


def test_similar(spark):
    docs = spark.createDataFrame(VECTORS, "id string, embedding array<double>")
    got = similarity.search_similar(docs, [1, 0], 10).collect()
    assert [r.id for r in got] == ["a", "g", "c", "b", "e", "f"]
    assert [r.similarity for r in got][0] == 1 and [r.similarity for r in got][3:] == [0, 0, 0]
    plan = similarity.search_similar(docs, [1, 0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("block", [4_000_000, 2])
def test_similar_batch_agrees_with_single(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "MAX_QUERY_VALUES", block)
    docs = spark.createDataFrame(VECTORS, "id string, embedding array<double>").repartition(3)
    queries = [(1, [1.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0]), (4, [0.0, 0.0])]
    batch = similarity.search_similar_batch(docs, spark.createDataFrame(queries, "query_id bigint, embedding array<double>"), 3).collect()
    for name, vector in queries:
        single = similarity.search_similar(docs, vector, 3).collect()
        rows = sorted((r for r in batch if r.query_id == name), key=lambda r: r["rank"])
        assert [r.id for r in rows] == [r.id for r in single]
        assert [r.similarity for r in rows] == pytest.approx([r.similarity for r in single])


def test_similar_batch_holds_blocks_and_tiles_only(spark, monkeypatch):
    """No task holds the scores of all its queries, and no vector comes to the driver."""
    rng, sizes = np.random.default_rng(5), []
    docs = [(f"d{k:03}", [float(x) for x in rng.integers(-2, 3, 3)]) for k in range(120)] + VECTORS
    queries = [(k % 50, v) for k, (_, v) in enumerate(docs[:100])]  # ids come twice
    frames = spark.createDataFrame(docs, "id string, embedding array<double>"), spark.createDataFrame(queries, "query_id bigint, embedding array<double>")
    want = sorted(similarity.search_similar_batch(*frames, 4).collect())
    assert len(want) == 200
    for name, value in (("MAX_DOC_ROWS", 31), ("MAX_QUERY_ROWS", 17), ("TILE", 60)):
        monkeypatch.setattr(similarity, name, value)
    assert sorted(similarity.search_similar_batch(*frames, 4).collect()) == want
    top = similarity._top
    monkeypatch.setattr(similarity, "_top", lambda n, i, scores, k: (sizes.append(scores.size), top(n, i, scores, k))[1])
    frame = lambda rows, names: pd.DataFrame(rows, columns=names)
    similarity._best(frame(docs[:30], ["id", "embedding"]), frame(queries, ["query_id", "v"]), 4)
    assert len(sizes) == 50 and max(sizes) == 60
    assert not len(similarity._best(frame(docs[:0], ["id", "embedding"]), frame(queries, ["query_id", "v"]), 4))


def test_display_rows(spark):
    enhanced = spark.createDataFrame(
        [("p", ({"line_coverage": "85.25", "x": "n/a"}, [("dead_code", "D", "High", ["a/b", "c"])], {"k/v": ["w"]}))],
        "path string, analysis struct<code_quality_metrics:map<string,string>,"
        "insights:array<struct<type:string,description:string,impact:string,components:array<string>>>,"
        "cross_references:map<string,array<string>>>")
    metrics = {r.key: (r.label, r.band, r.value_text) for r in pages.metric_rows(enhanced).collect()}
    assert metrics["line_coverage"] == ("Line Coverage", "high", "85.2")
    insight = pages.insight_rows(enhanced).first()
    assert insight.label == "Dead Code" and insight.impact_class == "badge-danger"
    assert [tuple(c) for c in insight.components] == [("a/b", "/components/a-b.html"), ("c", "/components/c.html")]
    assert [tuple(r) for r in pages.cross_reference_rows(enhanced).collect()] == [("p", "k/v", "/components/k-v.html")]


def test_file_components(spark):
    docs = spark.createDataFrame([("x/a.go", "A"), ("m.go", "M")], "path string, content string")
    refs = spark.createDataFrame([("x/a.go", 0, "t"), ("x/a.go", 1, "u")], "path string, pos int, target string")
    comps = project.file_components(docs)
    rows = {r.path: (r.name, r.type, r.n_references) for r in project.file_component_counts(comps, refs).collect()}
    assert rows == {"x/a.go": ("a.go", "file", 2), "m.go": ("m.go", "file", 0)}
    packaged = project.by_package(comps.select("name", "path")).select("path", "package", "ord")
    assert {tuple(r) for r in packaged.collect()} == {("x/a.go", "x", 1), ("m.go", "root", 1)}
