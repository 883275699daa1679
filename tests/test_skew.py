"""Hot groups: the split path gives what the plain one gives."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import skew
from sourceloom.operators.skew import SkewPolicy, text_parts, with_rank

FORCED = SkewPolicy(max_rows=50)


@pytest.fixture(scope="module")
def lopsided(spark):
    """Key 0 holds well over a third of all rows."""
    n = 6000
    return spark.range(n).select(
        F.when(F.col("id") % 3 != 1, 0).otherwise(F.col("id") % 40).cast("int").alias("g"),
        F.sha2(F.col("id").cast("string"), 256).alias("k"), "id",
    )


def brute_ranks(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.g].append((r.k, r.id))
    return {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}


@pytest.mark.parametrize("policy", [SkewPolicy(), FORCED])
def test_rank_per_group(lopsided, policy):
    got = with_rank(lopsided, ["g"], ["k"], "r", weight=F.col("id"), policy=policy).collect()
    want = brute_ranks(lopsided.collect())
    assert {r.id: r.r for r in got} == want
    before = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.g, r.r)):
        assert r.r_before == before[r.g]
        before[r.g] += r.id


def test_rank_without_group(lopsided):
    got = with_rank(lopsided, [], ["k"], "r", policy=FORCED).collect()
    assert [r.r for r in sorted(got, key=lambda r: r.k)] == list(range(1, len(got) + 1))


def test_hot_group_is_ranked_in_several_tasks(lopsided):
    plan = with_rank(lopsided, ["g"], ["k"], "r", policy=FORCED)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number() windowspecdefinition(g" in text and "__range" in text


def test_small_files_with_one_hot_key_are_split(spark, tmp_path):
    """Ten million rows of one key are a file of a few kilobytes."""
    spark.range(10_000_000).select(F.lit(1).alias("g"), "id").write.parquet(str(tmp_path / "t"))
    plan = with_rank(spark.read.parquet(str(tmp_path / "t")), ["g"], ["id"], "r")
    assert "__range" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.agg(F.count_if(F.col("r") == F.col("id") + 1)).first()[0] == 10_000_000


def test_long_lines_are_split_by_bytes(lopsided):
    policy = SkewPolicy(max_bytes=10_000)
    plan = with_rank(lopsided, ["g"], ["k"], "r", weight=F.lit(100), policy=policy)
    assert "__range" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.r for r in plan.collect()} == brute_ranks(lopsided.collect())


@pytest.mark.parametrize("policy", [SkewPolicy(), FORCED])
def test_text_parts_join_to_the_whole_page(lopsided, policy):
    lines = lopsided.withColumn("line", F.concat("k", F.lit("\n")))
    parts = text_parts(lines, ["g"], ["k"], part_bytes=3000, policy=policy).collect()
    want = defaultdict(list)
    for r in lopsided.collect():
        want[r.g].append(r.k)
    got = defaultdict(list)
    for r in sorted(parts, key=lambda r: (r.g, r.part)):
        assert len(r.body_md) <= 3000 + 65
        got[r.g].append(r.body_md)
    assert {g: "".join(x) for g, x in got.items()} == {g: "\n".join(sorted(x)) + "\n" for g, x in want.items()}
    assert len(got[0]) > 20


@pytest.mark.parametrize("policy", [SkewPolicy(), FORCED])
def test_more_rows_get_more_tasks(spark, lopsided, monkeypatch, policy):
    """A task ranks and assembles so many rows, whatever the number of shuffle partitions."""
    lines = lopsided.select("g", "k", F.concat("k", F.lit("\n")).alias("line"))
    want = sorted(text_parts(lines, ["g"], ["k"], part_bytes=1000, policy=policy).collect())
    monkeypatch.setattr(skew, "TASK_ROWS", 500)
    found = text_parts(lines, ["g"], ["k"], part_bytes=1000, policy=policy)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ", 12), REPARTITION_BY_NUM" in plan  # 6,000 rows
    assert sorted(found.collect()) == want
