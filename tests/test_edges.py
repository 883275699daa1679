"""The three-file sample and interface matching."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import analysis, edges



def comp(name, kind, deps=()):
    return {"name": name, "type": kind, "description": "", "visibility": "public",
            "dependencies": list(deps), "notable_features": []}


def rel(a, b, kind):
    return {"from": a, "to": b, "type": kind}


RESPONSES = {
    "in/math/calculator.go": json.dumps({
        "purpose": "Provides basic mathematical operations through a Calculator struct.",
        "components": [comp("Calculator", "struct"), comp("Add", "method")],
        "relationships": [rel("Add", "Calculator", "Method-Belongs-To")], "insights": ["small"]}),
    "in/math/operations.go": json.dumps({
        "purpose": "Defines an interface for mathematical operations with a single addition method.",
        "components": [comp("Operations", "interface"), comp("add", "method")]}),
    "in/main.go": json.dumps({
        "purpose": "", "components": [comp("main", "function", ["math.Calculator", "math.Add", "fmt"])],
        "relationships": [rel("main", "Calculator", "Instantiates"), rel("main", "Calculator", " instantiation "),
                          rel("", "x", "uses"), rel("x", "", "uses")], "insights": None}),
    "in/bad1.go": '{"purpose": "cut',
    "in/bad2.go": '```json\n{"purpose": "fenced"}\n```',
    "in/bad3.go": '{"purpose": "x"} and more',
    "in/bad4.go": '[{"purpose": "x"}]',
    "in/bad5.go": '{"purpose": "x", "insights": "text"}',
    "in/bad6.go": "",
}


@pytest.fixture(scope="module")
def responses(spark):
    return spark.createDataFrame(list(RESPONSES.items()), "path string, response string")


@pytest.fixture(scope="module")
def docs(responses):
    good, _ = analysis.parse_analysis(responses)
    return analysis.analysis_documents(good, "2024-01-01 00:00:00")


def test_parse(responses):
    good, bad = analysis.parse_analysis(responses)
    rows = {r.path: r.analysis for r in good.collect()}
    assert set(rows) == {"in/main.go", "in/math/calculator.go", "in/math/operations.go"}
    assert rows["in/math/operations.go"].relationships == [] and rows["in/main.go"].insights == []
    assert {r.path: r.response for r in bad.collect()} == {k: v for k, v in RESPONSES.items() if "bad" in k}


def test_each_answer_is_parsed_once(responses):
    plan = analysis.parse_analysis(responses)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_sample_edges(docs):
    known = edges.known_paths(docs)
    by_id = {r.id: r.path for r in docs.select("id", "path").collect()}
    got = {
        (by_id[r.source_id], by_id.get(r.target_id, r.target_id), r.type, r.producer)
        for r in edges.document_edges(docs, known).collect()
    }
    assert got == {
        ("in/math/calculator.go", "Calculator", "belongs-to", 1),
        ("in/math/calculator.go", "in/math/operations.go", "implements", 2),
        ("in/main.go", "in/math", "imports", 0),
        ("in/main.go", "Calculator", "creates", 1),
    }


def test_parent_candidate_wins(spark):
    paths = spark.createDataFrame([("r/a/x.go",), ("r/b/y.go",), ("r/a/b/z.go",)], "path string")
    doc = spark.createDataFrame(
        [("d", "r/a/x.go", [comp("c", "f", ["b.F", ".hidden", "nope.G", "b.H"])], [rel("c", "b", "uses")])],
        "id string, path string, components array<struct<name:string,type:string,description:string,visibility:string,"
        "dependencies:array<string>,notable_features:array<string>>>, relations array<struct<from:string,to:string,type:string>>")
    known = edges.known_paths(paths)
    assert {r.path for r in known.collect()} == {
        ".", "r", "r/a", "r/b", "r/a/b", "r/a/x.go", "r/b/y.go", "r/a/b/z.go"}
    assert {r.target_id for r in edges.import_edges(doc, known).collect()} == {"r/b", "r"}
    assert {r.target_id for r in edges.relation_edges(doc, known).collect()} == {"r/a/b"}


def test_interface_matching_against_brute_force(spark):
    rng = random.Random(3)
    names = ["m%d" % i for i in range(5)]
    rows = []
    for i in range(120):
        kind = rng.random()
        methods = sorted(rng.sample(names, rng.randint(0, 3)))
        rows.append((f"d{i:03}", "hot" if i % 3 else f"dir{i % 5}", kind < 0.7, kind > 0.4, methods))
    sides = spark.createDataFrame(rows, "id string, dir string, has_struct boolean, has_interface boolean, methods array<string>")
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] and b[3] and set(b[4]) <= set(a[4])}
    got = edges.implements_pairs(sides).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_merge_is_idempotent(spark):
    one = spark.createDataFrame([("a", "b", "uses", 0), ("a", "b", "uses", 1), ("a", "c", "uses", 2)],
                                "source_id string, target_id string, type string, ord int")
    once = edges.merge_edges(one, one)
    assert {(r.target_id, r.producer) for r in once.collect()} == {("b", 0), ("c", 0)}
    again = edges.merge_edges(once.select("source_id", "target_id", "type", F.lit(0).alias("ord")))
    assert again.drop("producer").exceptAll(once.drop("producer")).count() == 0


def test_resolve_targets(spark, docs):
    found = edges.resolve_targets(
        spark.createDataFrame([("a", "in/main.go", "uses"), ("a", "x", "uses")], "source_id string, target_id string, type string"), docs)
    ids = {r.target_id: r.target_doc_id for r in found.collect()}
    assert ids["x"] is None and len(ids["in/main.go"]) == 16


def test_to_enhanced(spark):
    answer = json.dumps({"purpose": "p", "insights": ["i1"], "relationships": [
        rel("a", "b", "x"), rel("c", "d", "x"), rel("a", "e", "x"), rel("a", "b", "y")]})
    good, _ = analysis.parse_analysis(spark.createDataFrame([("p", answer)], "path string, response string"))
    x = good.select(analysis.to_enhanced("analysis").alias("x")).first().x
    assert x.cross_references == {"a": ["b", "e", "b"], "c": ["d"]}
    assert [tuple(i) for i in x.insights] == [("general", "i1", "medium", [])]
    assert x.architectural_patterns == [] and x.code_quality_metrics == {}
    missing = good.select(analysis.to_enhanced(F.when(F.lit(False), F.col("analysis"))).alias("x")).first().x
    assert missing is None


def test_parse_enhanced_keeps_metric_text(spark):
    answer = json.dumps({"code_quality_metrics": {"a": 1.5, "b": {"c": [1]}, "d": "x"}, "cross_references": {"k": ["v"]}})
    good, bad = analysis.parse_enhanced(spark.createDataFrame([("p", answer), ("q", "nope")], "path string, response string"))
    a = good.first().analysis
    assert a.code_quality_metrics == {"a": "1.5", "b": '{"c":[1]}', "d": "x"} and a.insights == []
    assert [r.path for r in bad.collect()] == ["q"]


def test_adjacency_parts(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "from string, seq int, to string")
    whole = {r["from"]: r.targets for r in edges.adjacency(rows).collect()}
    assert whole == {"a": "x,y", "b": "z"}
    assert edges.adjacency(rows, part_bytes=2).count() == 3
