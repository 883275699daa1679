"""The pipeline against plain versions of its stages, each on the rows the stage got."""

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from sourceloom.llm.shared import kept
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of every stage, as the pipeline passes them on."""
    rows, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = kept(stage(spark, rows, SF))
        out[name] = (rows, made)
        rows = made
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


def test_order_and_columns(steps):
    assert list(steps) == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece"]
    for before, after in list(steps.values())[:-1]:
        assert after.dtypes == before.dtypes


def test_quality_keeps_good_and_drops_bad(spark, steps):
    before, after = map(texts, steps["quality_classifier"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in before}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in after for i in good) >= 0.95 * len(good)
    assert all(after[i] == before[i] for i in after) and len(after) < len(before)


def test_near_copies(steps):
    before, after = map(texts, steps["minhash_near_dedup"])
    assert after == {i: before[i] for i, c in brute.classes(before, 5).items() if i == c}


def test_repeated_strings(steps):
    before, after = map(texts, steps["suffix_array_dedup"])
    hits = brute.covered([before[i] for i in sorted(before)], 100)
    for i, hit in zip(sorted(before), hits, strict=True):
        rest = bytes(b for p, b in enumerate(before[i].encode()) if p not in hit)
        assert after[i] == rest.decode("utf-8", "ignore")
    sizes = steps["suffix_array_dedup"][1].where(F.col("n_chars") != F.length("text"))
    assert sizes.count() == 0


def test_benchmark_leaks(spark, steps):
    before, after = map(texts, steps["benchmark_decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert after == {i: t for i, t in before.items() if not brute.hits(t, items)[1]}


def test_pieces(steps):
    before = texts(steps["sentencepiece"][0])
    plain = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    assert {r.doc_id: r.ids for r in steps["sentencepiece"][1].collect()} == {i: plain.encode(t) for i, t in before.items()}


def test_odd_rows_pass_all_stages(spark, odd):
    rows = odd
    for name, stage in corpus_pipeline.STAGES:
        columns = rows.columns
        rows = kept(stage(spark, rows, SF))
        assert name == "sentencepiece" or rows.columns == columns
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
