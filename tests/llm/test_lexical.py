import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from sourceloom.llm import lexical
from tests.llm.brute import LOWER
from tests.llm.conftest import LONG, prose


def terms(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(docs, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        scores = []
        for doc, count, size in held:
            m = 75 + (25 * size * n) // total
            score = sum(weight[t] * ((10**9 * count[t]) // (1000 * count[t] + 12 * m)) for t in terms(text) if t in count)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -score) for r, (score, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(docs, items, k=5):
    return sorted((tuple(r) for r in lexical.search(docs, items, k).collect()), key=repr)


def items_of(spark, rows):
    schema = "item_id bigint, text string, item string, term string, score string, rank string, doc_id string"
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], schema)


ITEMS = [(1, "the and of0 One"), (2, None), (3, ""), (4, " ... "), (None, "one ONE the"), (1, "the and of0 One"), (6, prose(1, 30)), (7, "a b İ é漢é"), (8, "absent"), (9, LONG)]


@pytest.mark.parametrize("block, batch", [(10**6, 8 << 20), (3, 200)])
def test_odd(spark, docs_of, odd, monkeypatch, block, batch):
    """Odd rows on both sides, in one block and in many, in one batch and in many."""
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 10**6 if block > 3 else 400)
    monkeypatch.setattr(lexical, "BATCH_BYTES", batch)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd, items_of(spark, ITEMS)) == plain(docs, ITEMS, 5)


def test_ties_and_copies(spark, docs_of):
    docs = [(i % 40, "same words here") for i in range(60)] + [(100 + i, prose(i, 6)) for i in range(30)] + [(None, "same words here")]
    items = [(1, "same"), (2, "here same words words"), (3, "the of")]
    assert found(docs_of(docs), items_of(spark, items), 20) == plain(docs, items, 20)


def test_random(spark, docs_of):
    rng = random.Random(3)
    docs = [(i, prose(i, rng.randint(1, 120))) for i in range(300)]
    common = [prose(1000 + i, 8) for i in range(6)]
    items = [(i, " ".join(rng.sample(common, 3)) + " " + prose(2000 + i, 12)) for i in range(40)]
    assert found(docs_of(docs), items_of(spark, items), 20) == plain(docs, items, 20)


def test_empty(spark, docs_of):
    assert found(docs_of([]), items_of(spark, ITEMS)) == []
    assert found(docs_of([(1, "the one")]), items_of(spark, [])) == []


def test_shared_sets_are_made_once():
    held = {0: [(0, 1), (1, 1), (2, 1), (5, 1)], 1: [(0, 1), (1, 1), (2, 1), (4, 2)], 2: [(0, 1), (3, 1), (1, 1), (2, 1)], 3: [(6, 1)]}
    plan = lexical.shared_sets(held, pa.array([b"x"] * 7))

    def spread(node):
        return [plan.leaves[node]] if node < len(plan.leaves) else [x for m in plan.sets[node] for x in spread(m)]

    assert {item: sorted(x for n in nodes for x in spread(n)) for item, nodes in plan.items} == {i: sorted(v) for i, v in held.items()}
    common = [n for n, members in enumerate(plan.sets) if sorted(spread(n)) == [(0, 1), (1, 1), (2, 1)] and members]
    assert len(common) == 1 and all(common[0] in nodes for item, nodes in plan.items if item < 3)
