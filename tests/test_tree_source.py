"""The tree as a data source gives what the scan gives."""

import os

import pytest

from sourceloom.sources import tree_source
from sourceloom.sources.tree import list_tree, scan_tree


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "t"
    for k in range(30):
        folder = root / f"d{k % 4}" / f"e{k % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{k}.go").write_text(f"text {k}")
        (folder / f"F{k}.CS").write_bytes(b"\xff" * k)
    (root / "main.go").write_text("é漢")
    (root / "noext").write_text("x")
    (root / "empty").mkdir()
    os.symlink(root / "d0", root / "linked")
    os.symlink(root / "main.go", root / "link.go")
    return str(root)


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("folders, files", [(256, 2000), (1, 2000), (3, 2), (0, 5)])
def test_like_the_scan(spark, tree, monkeypatch, folders, files):
    monkeypatch.setattr(tree_source, "PLAN_FOLDERS", folders)
    monkeypatch.setattr(tree_source, "FILES_PER_TASK", files)
    for extensions in (None, [" go", ".CS "], ["nothing"]):
        assert rows(tree_source.read_tree(spark, tree, extensions)) == rows(scan_tree(spark, tree, extensions))
    assert rows(tree_source.read_tree(spark, "file://" + tree, content=False)) == [
        (n, p.removeprefix("file://")) for n, p in rows(list_tree(spark, "file://" + tree))]
    assert rows(tree_source.read_tree(spark, tree + "/gone")) == []


def test_large_folders_are_split_and_small_ones_share(tree, monkeypatch):
    monkeypatch.setattr(tree_source, "FILES_PER_TASK", 4)
    parts = tree_source.TreeReader({"path": tree, "extensions": "go"}, True).partitions()
    assert all(not p.deep for p in parts) and 3 <= len(parts) <= 31
    monkeypatch.setattr(tree_source, "FILES_PER_TASK", 1)
    split = tree_source.TreeReader({"path": tree + "/d0/e0"}, True).partitions()
    assert [p.shares for p in split] == [len(split)] * len(split) and len(split) > 1
    reader = tree_source.TreeReader({"path": tree + "/d0/e0"}, True)
    found = [r[0] for p in split for r in reader.read(p)]
    assert len(found) == len(set(found)) == len(list(tree_source.entries(tree + "/d0/e0")))


def test_listing_opens_no_file(tree, monkeypatch):
    def refuse(self, path):
        raise AssertionError("opened " + path)

    monkeypatch.setattr(tree_source.TreeReader, "text", refuse)
    reader = tree_source.TreeReader({"path": tree}, False)
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == 63
    # nor does a scan open what its filters leave out
    reader = tree_source.TreeReader({"path": tree, "containing": "/none/"}, True)
    assert [r for p in reader.partitions() for r in reader.read(p)] == []


def test_filters_on_one_frame(spark, tree):
    """One frame filtered in several ways, one after the other."""
    read = tree_source.read_tree(spark, tree)
    for where in ("path like '%.go' and length > 6", f"path = '{tree}/main.go'", "length <= 3", f"path like '{tree}/d1/%'", "length in (5, 6) or path like '%noext'"):
        assert rows(read.where(where)) == rows(scan_tree(spark, tree).where(where))
    assert rows(tree_source.read_tree(spark, tree, containing="/e2/")) == rows(read.where("path like '%/e2/%'"))


def test_unreadable_files(tree):
    assert tree_source.TreeReader({"path": tree}, True).text(tree + "/gone.go") is None
    with pytest.raises(OSError):
        tree_source.TreeReader({"path": tree}, True).text(tree)
    assert tree_source.TreeReader({"path": tree, "skip_unreadable": "true"}, True).text(tree) is None
