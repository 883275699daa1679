"""Search by an index gives the rows of a scan, and reads the texts of candidates only."""

import random

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import lookups, trigrams

TEXTS = [
    ("Alpha", "x%y and İstanbul"), ("b", "ALPHA beta"), ("c", ""), (None, "only text"), ("only title", None), (None, None), ("🙂🙃🙂", "é漢é漢"),
    ("line\nbreak", "tab\tand\nline"), ("Alpha", "x%y and İstanbul"), ("ab", "cd"),
]


def table(spark, n=300):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
    rows = TEXTS + [(word(), " ".join(word() for _ in range(rng.randint(0, 30)))) for _ in range(n)]
    return spark.createDataFrame([(k, *r, "x") for k, r in enumerate(rows)], "id int, title string, description string, `odd.name` string").repartition(3)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = table(spark).cache()
    index = trigrams.TextIndex(f"file://{tmp_path_factory.mktemp('index')}/i", block_rows=20, buckets=8)
    trigrams.build(rows, index)
    return rows, index


QUERIES = ["alpha", "ALPHA", "x%y", "%", "", "ab", "cab", "abc", "abcd", "e d", "istanbul", "i̇stanbul", "é漢é", "🙂🙃🙂", "🙂🙃", "k\nb", "e\nb", "only t", "nowhere", "aaa", "d e a", "b cd"]


@pytest.mark.parametrize("query", QUERIES)
def test_same_rows_as_the_scan(spark, built, query):
    rows, index = built
    got = sorted(trigrams.indexed_search(spark, index, query).collect(), key=repr)
    assert got == sorted(lookups.search(rows, query).collect(), key=repr)


def test_a_common_trigram_is_split(spark, built):
    rows, index = built
    sizes = spark.read.parquet(index.postings.path).select(F.size("rows").alias("n"), "trigram").collect()
    assert max(r.n for r in sizes) <= 20 and len({r.trigram for r in sizes}) < len(sizes)


def test_only_blocks_with_candidates_are_read(spark, built):
    rows, index = built
    found = trigrams.indexed_search(spark, index, "é漢é")
    assert found.count() == 1
    assert trigrams.candidates(spark, index, "é漢é").count() == 1
    assert trigrams.candidates(spark, index, "nowhere").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    buckets = {f.split("bucket_of_8=")[1].split("/")[0] for f in trigrams.candidates(spark, index, "é漢é").inputFiles()}
    assert len(buckets) == 1  # one trigram, one bucket


def test_an_index_is_not_written_over(spark, built):
    rows, index = built
    with pytest.raises(Exception, match="already exists"):
        trigrams.build(rows, index)


def test_empty_table(spark, tmp_path):
    index = trigrams.TextIndex(f"file://{tmp_path}/i")
    trigrams.build(table(spark).where(F.lit(False)), index)
    assert trigrams.indexed_search(spark, index, "abc").count() == 0
