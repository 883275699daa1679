import pathlib
import random

import numpy as np
import pandas as pd
import pytest

from sourceloom.llm import setjoin
from sourceloom.llm.shared import shared_folder
from sourceloom.llm.words import NON_SPACE, words
from tests.llm import brute
from tests.llm.conftest import LONG, prose


def found(docs, size=4, percent=85):
    return sorted((tuple(r) for r in setjoin.linked(docs, size, percent).collect()), key=repr)


def plain(rows, size=4, percent=85):
    """Rows are keyed by their place, so ids may repeat or be null."""
    classes = brute.classes({k: t for k, (_, t) in enumerate(rows)}, size, percent)
    ids = {}
    for k, c in classes.items():
        if rows[k][0] is not None:
            ids[c] = min(ids.get(c, rows[k][0]), rows[k][0])
    # copies of a text are one class as well
    return sorted(((i, len(brute.shingle_set(t, size)), i if not brute.spaced(t) else ids.get(classes[k])) for k, (i, t) in enumerate(rows)), key=repr)


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 10**6)}" if rng.random() < share else w for w in text.split())


def family():
    """Chains of edits, copies, shared passages and equal ids."""
    passage, out = prose(500, 60), []
    for k in range(8):
        text = prose(k, 120)
        out += [(100 * k, text), (100 * k + 1, text)]
        for j in range(6):
            text = edited(text, 100 * k + j, 0.015)
            out.append((100 * k + 2 + j, text))
    out += [(2000 + k, passage + " " + prose(600 + k, n)) for k, n in enumerate([4, 6, 8, 10, 14, 30, 80])]
    out += [(100, prose(77, 50)), (None, out[0][1]), (None, edited(out[0][1], 5, 0.004)), (None, prose(78, 40)), (None, edited(prose(78, 40), 6, 0.01))]
    return out


def test_odd(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd) == plain(rows)


def test_family(docs_of):
    rows = family()
    assert found(docs_of(rows)) == plain(rows)
    assert found(docs_of(rows), 5, 80) == plain(rows, 5, 80)


def test_small_cells(docs_of, monkeypatch):
    """Cells of a few sets, blocks of two, ids by shuffle, few counters."""
    monkeypatch.setattr(setjoin, "CELL", 300)
    monkeypatch.setattr(setjoin, "SKIP", 2)
    monkeypatch.setattr(setjoin, "BROADCAST_ROWS", 0)
    rows = family()
    assert found(docs_of(rows)) == plain(rows)


def test_nothing_linked_and_empty(docs_of):
    rows = [(i, prose(i, 30)) for i in range(20)]
    assert found(docs_of(rows)) == plain(rows)
    assert found(docs_of([])) == []


@pytest.mark.parametrize("seed", range(6))
def test_cells_find_all_classes(seed):
    """Without any leader: bounds and blocks lose no link between classes, and make none up."""
    rng = np.random.default_rng(seed)
    base = [rng.choice(10**6, 80, replace=False) for _ in range(4)]
    sets = []
    for k in range(60):
        s = base[k % 4].copy()
        s[rng.choice(80, rng.integers(0, 14), replace=False)] = rng.choice(np.arange(10**6, 2 * 10**6), 1)
        sets.append(np.unique(s).astype(np.uint64))
    # a list that all share at the first place, and some related classes known so far
    sets = [np.concatenate([np.zeros(1, np.uint64), s]) for s in sets]
    n = np.array([len(s) for s in sets])
    component = np.array([k if k % 8 else 0 for k in range(60)])
    rows = [(k, component[k], n[k], 0, list(sets[k].view(np.int64)), False) for k in range(60)]
    rows += [(k, component[k], n[k], 0, list(sets[k].view(np.int64)), True) for k in range(60) if component[k]]
    cell = pd.DataFrame(rows, columns=["node", "component", "n", "at", "hashes", "outside"])
    links = setjoin.compared(cell, 85)
    first = np.cumsum([0, *(len(h) for h in cell.hashes)])
    profiled = cell.assign(profile=setjoin.profiles(np.concatenate(cell.hashes).view(np.uint64), first).to_pylist())
    assert sorted(setjoin.compared(setjoin.possible(profiled, 85).reset_index(drop=True), 85)) == sorted(links)
    ok = lambda a, b: 100 * (i := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (n[a] + n[b] - i)
    assert all(ok(a, b) for a, b in links)
    joined = list(component)
    for a, b in links:
        x, y = joined[a], joined[b]
        joined = [y if c == x else c for c in joined]
    for a in range(60):
        for b in range(a):
            if ok(a, b) and (component[a] or component[b]):
                assert joined[a] == joined[b]


def test_words_of_1024_letters_differ():
    """Two words that polynomial hashes modulo 2**64 cannot tell apart."""
    import pyarrow as pa

    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    for n in (128, 512, 1024, 2048):
        assert len(set(words(pa.array([a[:n], b[:n]]), NON_SPACE).hash.tolist())) == 2


def test_long_words_are_told_apart(docs_of):
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, a), (4, LONG), (5, LONG)]
    assert found(docs_of(rows)) == plain(rows)


def test_tables_that_were_read_are_deleted(spark):
    nodes = spark.createDataFrame([(1, 3, [5, 6]), (2, 3, [5, 7]), (3, 4, [6, 7])], "node bigint, n bigint, prefix array<bigint>")
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = {*folder.glob("sourceloom-*")}
    lists = setjoin.shared_lists(nodes)
    assert len({*folder.glob("sourceloom-*")} - before) == 1
    assert sorted((r.token, r.node) for r in lists.collect()) == [(5, 1), (5, 2), (6, 1), (6, 3), (7, 2), (7, 3)]


def test_prefixes_are_deleted_once_lists_are_made(spark, docs_of, monkeypatch):
    folder, seen = pathlib.Path(shared_folder(spark).removeprefix("file:")), []
    before = {*folder.glob("sourceloom-*")}

    def watched(name):
        step = getattr(setjoin, name)

        def run(*given):
            tables = [spark.read.parquet(str(f)).columns for f in {*folder.glob("sourceloom-*")} - before]
            seen.append((name, sum("prefix" in columns for columns in tables)))
            return step(*given)

        monkeypatch.setattr(setjoin, name, run)

    for name in ("shared_lists", "leader_pairs"):
        watched(name)
    rows = family()
    got = setjoin.linked(docs_of(rows), size=4, percent=85)
    assert got.count() == len(rows) and got.count() == len(rows)
    assert seen == [("shared_lists", 1), ("leader_pairs", 0)]
