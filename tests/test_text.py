import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourceloom.functions import formats as f
from sourceloom.functions.labels import RELATION_TYPES, edge_key, relation_type
from sourceloom.functions.vectors import cosine
from sourceloom.operators.chunking import chunk_documents


def brute_chunks(text, size):
    out, held, start, count = [], "", 1, 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        held += line + "\n"
        count += 1
        if len(held.encode()) >= size or i == len(lines) - 1:
            out.append((held, start, start + count - 1))
            held, start, count = "", start + count, 0
    return out


def chunks_of(spark, texts, size):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = chunk_documents(docs, "id", "text", size).orderBy("id", "start_line").collect()
    got = {i: [] for i in range(len(texts))}
    for r in rows:
        got[r.id].append((r.content, r.start_line, r.end_line))
    return got


@pytest.mark.parametrize("size", [0, 1, 2, 6, 400])
def test_chunks_match_brute_force(spark, size):
    texts = ["", "\n", "ab\ncd\nef", "a\n\n\nb\n", "x" * 50 + "\ny", "é\nüü\n漢字\n\U0001f600\nz", "a\r\nb\r\n",
             "\n".join("line %d" % i for i in range(700))]
    got = chunks_of(spark, texts, size)
    for i, text in enumerate(texts):
        assert got[i] == brute_chunks(text, size)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab\né漢 ", max_size=40), min_size=10, max_size=30), st.integers(1, 12))
def test_chunk_properties(spark, texts, size):
    got = chunks_of(spark, texts, size)
    for i, text in enumerate(texts):
        assert got[i] == brute_chunks(text, size)
        assert "".join(c for c, _, _ in got[i]) == text + "\n"


def test_chunking_does_not_shuffle(spark):
    docs = spark.createDataFrame([(1, "a")], "id long, text string")
    plan = chunk_documents(docs, "id", "text", 400)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def brute_type(label):
    text = label.lower().strip()
    if text in RELATION_TYPES:
        return RELATION_TYPES[text]
    return next((v for k, v in RELATION_TYPES.items() if k in text), text)


def test_relation_types(spark):
    labels = [*RELATION_TYPES, *(f"  {k.upper()} \t" for k in RELATION_TYPES), "uses method", "Owns", "",
              "has-method calls", " Instantiates ", "method-belongs-to-struct-x", " uses　"]
    rows = spark.createDataFrame([(x,) for x in labels], "x string").select(
        "x", relation_type("x").alias("t"), relation_type(relation_type("x")).alias("again")
    ).collect()
    for r in rows:
        assert r.t == brute_type(r.x)
        assert r.again == r.t


def test_edge_key(one):
    import hashlib
    want = hashlib.sha256(b"a:b:uses").hexdigest()[:32]
    assert one(edge_key("s", "t", "k"), s="a", t="b", k="uses") == want


@pytest.mark.parametrize(("name", "want"), [
    ("line_coverage", "Line Coverage"), ("dead-code of USERS", "Dead-Code Of USERS"), ("", ""),
    ("élan x", "Élan X"), ("__a", "  A"),
])
def test_format_type(one, name, want):
    assert one(f.format_type("x"), x=name) == want


@pytest.mark.parametrize(("impact", "want"), [
    ("HIGH", "badge-danger"), ("medium", "badge-warning"), ("Low", "badge-info"), ("?", "badge-secondary"),
])
def test_impact_class(one, impact, want):
    assert one(f.impact_class("x"), x=impact) == want


def test_metrics_and_dates(spark):
    rows = spark.createDataFrame([(80.0,), (60.0,), (59.95,), (0.25,), (0.75,), (0.15,)], "v double").select(
        f.metric_band("v").alias("band"), f.metric_text("v").alias("text")
    ).collect()
    assert [r.band for r in rows] == ["high", "medium", "low", "low", "low", "low"]
    assert [r.text for r in rows] == ["%.1f" % v for v in (80.0, 60.0, 59.95, 0.25, 0.75, 0.15)]
    day = spark.sql("select timestamp'2024-03-05 10:00:00' as t").select(f.format_date("t").alias("d")).first().d
    assert day == "March 5, 2024"


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([1.0], [1.0, 2.0], 0.0),
            ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0, 2.0], [-1.0, -2.0], -1.0), ([], [], 0.0)]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>, want double").select(
        "want", cosine("a", "b").alias("x"), cosine("b", "a").alias("y")
    ).collect()
    for r in got:
        assert r.x == pytest.approx(r.want) and r.x == r.y and abs(r.x) <= 1 + 1e-12
