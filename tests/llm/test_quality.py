import math

from pyspark.sql import functions as F

from sourceloom.llm import quality
from tests.llm.conftest import LONG, prose


def noisy(seed):
    return " | ".join(f"### {w} $$$" for w in prose(seed, 60).split())


def test_held_out_accuracy(spark, docs_of):
    rows = [(k, prose(k, 100) if k % 3 else noisy(k)) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 1, "t") for k in range(600)] + [(1, None, 0, "t"), (None, 1, 0, "t"), (2, 5, 0, "t")],
                                   "doc_id bigint, quality int, toxic int, text string")
    docs = docs_of(rows)
    model = quality.fit(docs, labels)
    got = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("out"), quality.score(docs, model).alias("s")).collect()
    out = [r for r in got if r.out]
    assert len(out) > 60 and all(0 <= r.s <= 1 for r in got)
    assert sum((r.s >= quality.THRESHOLD) == (r.doc_id % 3 > 0) for r in out) >= 0.97 * len(out)


def test_odd_rows_and_no_labels(spark, odd):
    labels = spark.createDataFrame([(1, 1), (5, 0), (8, 1)], "doc_id bigint, quality int")
    model = quality.fit(odd, labels)
    got = odd.select("doc_id", "text", quality.score(odd, model).alias("s")).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.s) for r in got)
    assert len({r.s for r in got if not r.text}) == 1 and any(r.text == LONG for r in got)
    none = quality.fit(odd, labels.limit(0))
    assert {r.s for r in odd.select(quality.score(odd, none).alias("s")).collect()} == {0.5}
    assert odd.limit(0).select(quality.score(odd, model).alias("s")).count() == 0


def test_curve():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=5_000)
    y = (rng.random(5_000) < 1 / (1 + np.exp(-(2 * x + 0.5)))).astype(float)
    slope, intercept = quality.logistic(x, y)
    assert abs(slope - 2) < 0.25 and abs(intercept - 0.5) < 0.2
    assert quality.logistic(np.ones(3), np.ones(3))[0] == 0
