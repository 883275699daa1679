import gzip
import json
import os
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import lookups
from sourceloom.operators.skew import PART_BYTES
from sourceloom.plans import files as queries
from sourceloom.schemas import DOCUMENT, REFERENCE
from sourceloom.sources import store
from sourceloom.sources import tree as scans
from sourceloom.sources.records import decode_rows, encode_rows
from sourceloom.sources.tree import classify_files, list_tree, scan_tree, split_rejects, with_extensions


@pytest.fixture
def tree(tmp_path):
    for name, text in {
        "main.go": "package main", "math/calculator.go": "package math é", "go.mod": "module x", "A.CS": "class A",
        "a.csproj": "<p/>", "a.sln": "s", "readme.md": "#", "noext": "n", "deep/er/b.py": "b",
    }.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "in")


def test_scan_and_classify(spark, tree):
    files = scan_tree(spark, tree)
    assert files.count() == 9
    rows = {r.path.removeprefix(tree + "/"): r for r in classify_files(files).collect()}
    assert {k: (r.language, r.type) for k, r in rows.items()} == {
        "main.go": ("go", "source"), "math/calculator.go": ("go", "source"), "go.mod": ("go", "module"),
        "A.CS": ("csharp", "source"), "a.csproj": ("csharp", "project"), "a.sln": ("csharp", "solution"),
    }
    assert rows["math/calculator.go"].content == "package math é"


def test_extension_list_is_case_sensitive_and_tolerant(spark, tree):
    names = lambda exts: {r.path.rsplit("/", 1)[1] for r in with_extensions(scan_tree(spark, tree), exts).collect()}
    assert names([" go", ".py "]) == {"main.go", "calculator.go", "b.py"}
    assert names(["cs"]) == set()
    assert {r.path.rsplit("/", 1)[1] for r in with_extensions(scan_tree(spark, tree)).collect()} == {
        "main.go", "calculator.go", "b.py"}
    assert {r.path.rsplit("/", 1)[1] for r in scan_tree(spark, tree, ["sln", ".py"]).collect()} == {"a.sln", "b.py"}


def test_scan_sees_every_file_and_opens_only_wanted_ones(spark, tree):
    root = pathlib.Path(tree)
    for name, data in {"_w.py": b"w", "p/__init__.py": b"", "_internal/y.py": b"y", ".hidden/z.py": b"z", "latin.py": b"caf\xe9",
                       "a b%20.py": b"s"}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    (root / "image.png").write_bytes(b"")
    os.truncate(root / "image.png", 1 << 33)  # never read
    (root / "self").symlink_to(root)
    rows = {r.path.removeprefix(tree + "/"): (r.content, r.length) for r in scan_tree(spark, tree, ["py"]).collect()}
    assert rows == {"_w.py": ("w", 1), "p/__init__.py": ("", 0), "_internal/y.py": ("y", 1), ".hidden/z.py": ("z", 1),
                    "latin.py": ("caf\ufffd", 4), "a b%20.py": ("s", 1), "deep/er/b.py": ("b", 1)}
    assert list_tree(spark, tree).where("path like '%image.png'").first().length == 1 << 33
    assert {r.path for r in scan_tree(spark, "file://" + tree, ["sln"]).collect()} == {tree + "/a.sln"}


def joined(rows, root):
    """Text by path of rows that are parts of files."""
    texts = {}
    for r in sorted(rows, key=lambda r: (r.path, r.part)):
        texts.setdefault(r.path.removeprefix(root + "/"), []).append((r.part, r.content))
    assert all([p for p, _ in parts] == list(range(len(parts))) for parts in texts.values())
    return {path: "".join(t for _, t in parts) for path, parts in texts.items()}


@pytest.mark.parametrize("part_bytes", [4, 7, 64, 1 << 20])
def test_parts_of_files(spark, tmp_path, part_bytes):
    """Joined they are the text that a whole file has, wherever characters are cut or broken."""
    pieces = ["a", "\u00e9", "\u6f22", "\U0001f600"]
    broken = [p.encode() for p in pieces] + [b"\xff", b"\x80", b"\xed\xa0\x80", b"\xe1\x80", b"\xf0\x9f\x98", b"\xf4\x90", b"\xc2"]
    pick = random.Random(part_bytes)
    data = {f"f{n}.py": b"".join(pick.choice(broken) for _ in range(n)) for n in (0, 1, 2, 3, 5, 30, 500, 501)}
    data["tail.py"], data["sub/same.py"] = b"x" * (part_bytes * 3) + b"\xf0\x9f", "\u6f22".encode() * 700
    for name, content in data.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    (tmp_path / "in" / "packed.gz").write_bytes(gzip.compress(data["f501.py"]))
    root = str(tmp_path / "in")
    for start in (root, "file://" + root):
        rows = scan_tree(spark, start, ["py", "gz"], part_bytes=part_bytes).collect()
        assert joined(rows, root) == {k: v.decode("utf-8", "replace") for k, v in data.items()} | {
            "packed.gz": data["f501.py"].decode("utf-8", "replace")}
        assert {(r.path, r.length) for r in rows} == {(r.path, r.length) for r in scan_tree(spark, start, ["py", "gz"]).collect()}
        # A part has its bytes and at most three of the one before; the last up to twice as many.
        assert all(len(r.content) <= 2 * part_bytes + 3 for r in rows)
    assert joined(rows, root) == {r.path.removeprefix(root + "/"): r.content for r in scan_tree(spark, root).collect()}


def test_ranges_of_parts(spark, monkeypatch):
    """Large files are ranges of some parts, in more tasks the more there is; compressed ones are one range."""
    monkeypatch.setattr(scans, "TASK_BYTES", 1000)
    files = spark.createDataFrame([("a.py", 10 * 40 + 9), ("b.py", 10 * 32), ("c.py", 0), ("d.py", None), ("e.gz", 9999)], "path string, length bigint")
    ranges = scans._ranges(files, 10)
    assert {(r.path, r.first, r.stop) for r in ranges.collect()} == {
        ("a.py", 0, 32), ("a.py", 32, 0), ("b.py", 0, 0), ("c.py", 0, 0), ("d.py", 0, 0), ("e.gz", 0, 0)}
    assert ranges.count() == 6 and ranges.rdd.getNumPartitions() == 11


def test_file_that_shrinks_or_is_unreadable(tmp_path):
    store, path = scans.fs.LocalFileSystem(), tmp_path / "f"
    path.write_bytes(b"0123456789")
    assert list(scans._parts(store, str(path), 0, 4, 4)) == [(0, "0123"), (1, "456789")]
    assert list(scans._parts(store, str(path), 4, 8, 4)) == []
    with pytest.raises(FileNotFoundError):
        list(scans._parts(store, str(tmp_path / "gone"), 0, 0, 4))
    with pytest.raises(OSError):
        list(scans._parts(store, str(tmp_path), 0, 0, 4))


def test_large_tables_are_scanned_in_parts(spark, tmp_path, monkeypatch):
    """The whole of a large file is read, and no row holds more than a part or two of it."""
    large = b"PAR1" + b"\xff" * (40 * PART_BYTES) + b"PAR2"
    (tmp_path / "lineitem.parquet").write_bytes(large)
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "lineitem.parquet").write_bytes(b"PAR1 PAR3")
    (tmp_path / "tiny.parquet").write_bytes(b"P")
    (tmp_path / "none.parquet").write_bytes(b"")
    seen = []
    scan = lambda *args, **named: seen.append(scan_tree(*args, **named)) or seen[-1]
    monkeypatch.setattr(queries, "scan_tree", scan)
    found = queries.scan(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [
        ("lineitem.parquet", "PAR1", "PAR2"), ("lineitem.parquet", "PAR1", "PAR3"), ("none.parquet", "", ""), ("tiny.parquet", "P", "P")]
    size = F.octet_length("content")
    sizes = seen[0].agg(F.sum(size).alias("all"), F.max(size).alias("most")).first()
    assert sizes["all"] == 8 + 3 * 40 * PART_BYTES + 9 + 1
    assert sizes["most"] <= 2 * 3 * PART_BYTES + 9
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression") < plan.index("substring(content")  # sorted without content


def test_rejects(spark):
    files = spark.createDataFrame(
        [("a.go", "x"), ("b.go", ""), ("c", "x"), ("d.", "x"), ("e.go", None)], "path string, content string")
    good, bad = split_rejects(files)
    assert [r.path for r in good.collect()] == ["a.go"]
    assert {r.path: r.reason for r in bad.collect()} == {
        "b.go": "empty file content", "e.go": "empty file content",
        "c": "file has no extension", "d.": "file has no extension"}


def document(spark, doc_id, content, embedding=(), kind="module"):
    row = {f.name: None for f in DOCUMENT.fields} | {
        "id": doc_id, "path": f"/{doc_id}", "type": kind, "content": content,
        "embedding": list(embedding), "references": ["ref1", "ref2"]}
    return spark.createDataFrame([tuple(row.values())], DOCUMENT)


def test_document_json(spark):
    docs = document(spark, "test1", "Test content", [0.1, 0.2, 0.3])
    encoded = encode_rows(docs, "id")
    value = json.loads(encoded.first().value)
    assert value["insights"] is None and value["embedding"] == [0.1, 0.2, 0.3] and "created_at" in value
    back = decode_rows(encoded, DOCUMENT).first()
    assert back.insights == [] and back.references == ["ref1", "ref2"] and back.content == "Test content"


def test_store(spark, tmp_path):
    path = str(tmp_path / "docs")
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, path)
    seq = lambda df, n: df.withColumn("seq", F.lit(n))
    first = seq(document(spark, "test1", "old"), 1).unionByName(seq(document(spark, "arch", "a", kind="architecture"), 2))
    assert store.save_documents(first, path) == 0
    again = seq(document(spark, "test1", "mid"), 1).unionByName(seq(document(spark, "test1", "new"), 2))
    again = again.unionByName(seq(document(spark, "test2", "x"), 3))
    assert store.save_documents(again, path) == 1
    assert store.save_documents(again, path) == 2  # the same batch again changes nothing
    docs = store.read_table(spark, path)
    assert {(r.id, r.content) for r in docs.collect()} == {("test1", "new"), ("test2", "x"), ("arch", "a")}
    assert lookups.get_document(docs, "test1").count() == 1
    assert lookups.get_document(docs, "none").count() == 0
    assert [r.id for r in lookups.list_documents(docs, "module").collect()] == ["test1", "test2"]
    point = lookups.get_document(docs, "test1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,test1)" in point
    listed = lookups.list_documents(docs, "module")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(type" in listed


def test_unfinished_version_is_ignored(spark, tmp_path):
    path = str(tmp_path / "docs")
    store.save_documents(document(spark, "a", "1").withColumn("seq", F.lit(1)), path)
    (tmp_path / "docs" / "v=1").mkdir()
    assert store.current_version(spark, path) == 0
    assert store.save_documents(document(spark, "a", "2").withColumn("seq", F.lit(1)), path) == 2
    assert [r.content for r in store.read_table(spark, path).collect()] == ["2"]


def test_references_store(spark, tmp_path):
    path = str(tmp_path / "refs")
    edges = spark.createDataFrame(
        [("test1", "test2", "imports", None, 1), ("test1", "test2", "imports", None, 2), ("test1:x", "test2", "uses", None, 3)],
        "source_id string, target_id string, type string, created_at timestamp, seq int")
    store.save_references(edges, path)
    store.save_references(edges, path)
    refs = store.read_table(spark, path)
    assert refs.schema["created_at"].dataType == REFERENCE["created_at"].dataType
    assert refs.count() == 2
    assert lookups.out_edges(refs, "test1").count() == 1  # not the source that starts alike
    assert lookups.in_edges(refs, "test2").count() == 2


def test_search(spark):
    rows = spark.createDataFrame([("Alpha", "x%y"), ("b", "ALPHA"), ("c", "")], "title string, description string")
    assert lookups.search(rows, "aLpHa").count() == 2
    assert lookups.search(rows, "%").count() == 1
    assert lookups.search(rows, "").count() == 3


def test_edge_lookups_agree(spark):
    docs = spark.createDataFrame([("a", "pa"), ("b", "pb"), ("c", "pc")], "id string, path string")
    refs = spark.createDataFrame(
        [("a", "b", "uses"), ("a", "c", "uses"), ("b", "c", "calls"), ("c", "zz", "uses"), ("a", "a", "uses")],
        "source_id string, target_id string, type string")
    counts = {r.id: (r.n_deps, r.n_used_by) for r in lookups.edge_counts(docs, refs).collect()}
    assert counts == {"a": (3, 1), "b": (1, 1), "c": (1, 2)}
    rows = lookups.dependency_rows(docs, refs).collect()
    assert len(rows) == 5 and [r.target_path for r in rows if r.target_id == "zz"] == [None]
    outs = sorted((r.source_id, r.target_id) for s in "abc" for r in lookups.out_edges(refs, s).collect())
    ins = sorted((r.source_id, r.target_id) for t in ("a", "b", "c", "zz") for r in lookups.in_edges(refs, t).collect())
    assert outs == ins
