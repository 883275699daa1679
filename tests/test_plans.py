"""What building a query costs."""

import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sourceloom.operators import skew

SF = "/root/testdata/sf0.001"
# These write tables, or a checkpoint: that is what they are.
WRITES = ("a4_saved_batches", "a5_saved_batches", "b3_stored_out_edges", "b4_stored_in_edges", "b5_stored_edge_counts", "j6_stored_pages", "b6_indexed_search")


def jobs(spark, build):
    """Spark jobs that ``build`` runs."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "build")
    try:
        build()
        core = spark.sparkContext._jsc.sc()
        core.listenerBus().waitUntilEmpty()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)


@pytest.fixture(scope="module")
def tables(spark):
    """The tables, read once: Spark looks at a file's schema in a job of its own."""
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in names}


# f2_top_k_batch fetches its queries to the driver, and an index over whole texts is weighed
# first, as README says.
EAGER = (*WRITES, "f2_top_k_batch", "j4_index_page")
NAMES = [n for n in entry.queries() if n[0] in "bcdefgj" and n[1].isdigit() and n not in EAGER]


@pytest.mark.parametrize("name", NAMES)
def test_building_a_query_runs_no_job(spark, tables, monkeypatch, name):
    from sourceloom.plans import adapters

    monkeypatch.setattr(adapters, "table", lambda _spark, _sf, n: tables[n])
    assert jobs(spark, lambda: entry.queries()[name](spark, SF)) == 0


def test_row_bound(spark, tables, tmp_path):
    lines, rows = tables["lineitem"], tables["lineitem"].count()
    assert skew.row_bound(lines.select("l_orderkey").where("l_tax > 0").distinct().repartition(3)) == rows
    assert skew.row_bound(lines.select("l_partkey").unionByName(lines.select("l_partkey"))) == 2 * rows
    assert skew.row_bound(lines.select(F.explode(F.array("l_partkey", "l_suppkey")))) == 2 * rows
    assert skew.row_bound(lines.agg(F.max("l_tax"))) in (1, rows)
    assert skew.row_bound(lines.join(tables["part"], lines.l_partkey == tables["part"].p_partkey, "left_semi")) == rows
    # these may make more rows than they read
    assert skew.row_bound(lines.join(tables["part"], lines.l_partkey == tables["part"].p_partkey)) is None
    assert skew.row_bound(tables["embeddings"].select(F.explode("embedding"))) is None
    assert skew.row_bound(spark.range(10).selectExpr("id", "uuid() as u")) in (None, 10)
    many = str(tmp_path / "many")
    spark.range(200).repartition(skew.MAX_FOOTERS + 1).write.parquet(many)
    assert skew.row_bound(spark.read.parquet(many)) is None


def test_a_proven_bound_counts_nothing_and_hot_groups_still_split(spark, tables):
    lines = tables["lineitem"].selectExpr("l_suppkey as g", "l_orderkey * 10 + l_linenumber as o").distinct()
    small = skew.with_rank(lines, ["g"], ["o"])
    split = skew.with_rank(lines, ["g"], ["o"], policy=skew.SkewPolicy(max_rows=100))
    assert sorted(small.collect()) == sorted(split.collect())
