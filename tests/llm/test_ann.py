import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, vector string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], SCHEMA)


def exact(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = []
    for q in sorted(good):
        if q % 20 == 0:
            score = lambda i, q=q: float(np.dot(np.float64(np.float32(good[q])), np.float64(np.float32(good[i]))))
            same = [i for i in good if i != q and len(good[i]) == len(good[q])]
            out += [(q, r + 1, i, score(i)) for r, i in enumerate(sorted(same, key=lambda i: (-score(i), i))[:k])]
    return out


@pytest.mark.parametrize("shard", [4_096, 150])
def test_recall(spark, shard):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, size=(900, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    want = exact(rows, 20)
    got = [tuple(r) for r in ann.nearest(frame(spark, rows), F.col("id") % 20 == 0, shard=shard).collect()]
    assert len(got) == len(want)
    assert len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.95 * len(want)
    true = {(q, i): s for q, _, i, s in exact(rows, 900)}
    assert all(abs(s - true[q, i]) < 1e-12 for q, _, i, s in got)


def test_ties_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 2)
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(50 + i, [0.5, float(i)]) for i in range(5)]
    rows += [(60, None), (80, []), (100, [0.0, 0.0]), (120, [1.0, None]), (140, [1.0, float("nan")]), (160, [float("inf"), 1.0]),
             (None, [1.0, 1.0]), (180, [1.0, 2.0, 3.0]), (200, [1.0, 1.0, 1.0]), (40, [1.0, 0.0]), (201, [-0.0, 1.0])]
    got = sorted(tuple(r) for r in ann.nearest(frame(spark, rows), F.col("id") % 20 == 0, k=6).collect())
    assert got == sorted(exact(rows, 6))


def test_empty(spark):
    assert ann.nearest(frame(spark, []), F.col("id") % 20 == 0).count() == 0
    assert ann.nearest(frame(spark, [(20, [1.0])]), F.col("id") % 20 == 0).count() == 0


def test_graph_is_flat_arrays_with_several_layers():
    graph = ann.Graph.build(np.random.default_rng(2).normal(size=(600, 8)).astype(np.float32))
    assert len(graph.layers) > 1
    assert all((near < 600).all() and near.shape == (600, ann.DEGREE if k == 0 else ann.DEGREE // 2) for k, near in enumerate(graph.layers))
