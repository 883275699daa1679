"""Tables saved batch by batch."""

import os

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import lookups
from sourceloom.operators.pages import module_pages
from sourceloom.sources import keyed

SCHEMA = "id string, content string"


def table(spark, tmp_path, buckets=8, key=("id",)):
    schema = spark.createDataFrame([], SCHEMA).schema
    return keyed.KeyedTable(f"file://{tmp_path}/t", schema, key, "id", buckets)


def batch(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", seq int")


def files(tmp_path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def content(spark, t):
    return sorted(((r.id, r.content) for r in keyed.rows(spark, t).collect()), key=repr)


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path)
    assert content(spark, t) == [] and keyed.save(batch(spark, []), t) == []
    assert keyed.save(batch(spark, [(f"k{i}", "old") for i in range(200)]), t) == list(range(8))
    before = files(tmp_path)
    touched = keyed.save(batch(spark, [("k7", "mid"), ("k7", "new"), ("k7x", "added")]), t)
    after = files(tmp_path)
    changed = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    assert 0 < len(touched) <= 2
    assert {int(p.split("bucket_of_8=")[1].split("/")[0]) for p in changed} == set(touched)
    want = sorted([(f"k{i}", "new" if i == 7 else "old") for i in range(200)] + [("k7x", "added")])
    assert content(spark, t) == want
    assert keyed.save(batch(spark, [("k7", "new")]), t) and content(spark, t) == want  # the same again changes nothing
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_lookup_reads_one_bucket(spark, tmp_path):
    t = table(spark, tmp_path)
    keyed.save(batch(spark, [(f"k{i}", str(i)) for i in range(100)]), t)
    found = keyed.lookup(spark, t, "k5")
    assert [tuple(r) for r in found.collect()] == [("k5", "5")]
    assert len(found.inputFiles()) == 1 and "EqualTo(id,k5)" in plan(found)
    assert keyed.lookup(spark, t, "none").count() == 0


def test_null_keys_and_two_column_keys(spark, tmp_path):
    t = table(spark, tmp_path, key=("id", "content"))
    rows = [(None, "a"), (None, None), ("x", None), ("x", "a"), ("x", None)]
    keyed.save(batch(spark, rows), t)
    keyed.save(batch(spark, rows), t)
    assert content(spark, t) == sorted(set(rows), key=repr)


def test_another_session_finds_the_rows(spark, tmp_path):
    t = table(spark, tmp_path)
    keyed.save(batch(spark, [("a", "1"), ("b", "2")]), t)
    spark.sql(f"drop table {t.name}")
    other = keyed.KeyedTable(t.path, t.schema, t.key, t.by, 32)  # the folder keeps its own number
    assert content(spark, other) == [("a", "1"), ("b", "2")]
    keyed.save(batch(spark, [("b", "3")]), other)
    assert content(spark, t) == [("a", "1"), ("b", "3")]


def test_failed_save_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    keyed.save(batch(spark, [("a", "1"), ("b", "2")]), t)
    broken = batch(spark, [("a", "9"), ("b", "x")]).withColumn("content", F.when(F.col("id") == "a", "9").otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        keyed.save(broken, t)
    assert content(spark, t) == [("a", "1"), ("b", "2")]
    keyed.save(batch(spark, [("a", "9")]), t)
    assert content(spark, t) == [("a", "9"), ("b", "2")]


def stored(spark, tmp_path):
    path = f"file://{tmp_path}"
    ids = [f"d{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, f"p/{i}.go", "module", f"text {i}") for i in ids], "id string, path string, type string, content string")
    edges = [(a, b, "uses") for k, a in enumerate(ids) for b in ids[k + 1 : k + 4]] + [("d0", i, "calls") for i in ids] + [("d1", "gone", "uses")]
    refs = spark.createDataFrame(edges, "source_id string, target_id string, type string")
    table = lambda name, rows, key, by: keyed.KeyedTable(f"{path}/{name}", rows.schema, key, by, 4)
    tables = table("docs", docs, ("id",), "id"), table("out", refs, ("source_id", "target_id", "type"), "source_id"), table("in", refs, ("source_id", "target_id", "type"), "target_id")
    for rows, t in zip((docs, refs, refs), tables, strict=True):
        keyed.save(rows.withColumn("seq", F.lit(0)), t)
    return docs, refs, [keyed.rows(spark, t) for t in tables], tables


def test_edges_both_ways(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, refs, (held, by_source, by_target), tables = stored(spark, tmp_path)
        counts = lookups.stored_edge_counts(held.select("id", "path"), by_source, by_target)
        assert "Exchange" not in plan(counts)
        assert sorted(counts.collect()) == sorted(lookups.edge_counts(docs.select("id", "path"), refs).collect())
        pages = module_pages(held, by_source, by_target=by_target)
        plain = module_pages(docs, refs)
        # an edge meets its far end without an exchange: only by page are rows dealt
        assert plan(pages).count("Exchange hashpartitioning(far_id") == 0 < plan(plain).count("Exchange hashpartitioning(far_id")
        assert sorted(pages.collect()) == sorted(plain.collect())
        # a hot bucket is read as plain files, which Spark may split
        split = keyed.rows(spark, tables[1], large=1)
        assert "Exchange" not in plan(by_source.groupBy("source_id").count()) and "Exchange" in plan(split.groupBy("source_id").count())
        assert sorted(keyed.rows(spark, tables[1], large=1).collect()) == sorted(by_source.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_documents_and_references(spark, tmp_path):
    path = f"file://{tmp_path}"
    doc = spark.createDataFrame([], keyed.DOCUMENT)
    rows = spark.createDataFrame([("a", "pa"), ("b", "pb")], "id string, path string")
    rows = doc.unionByName(rows, allowMissingColumns=True).withColumn("seq", F.lit(1))
    keyed.save_documents(rows, path, buckets=4)
    assert [r.path for r in keyed.get_document(spark, path, "b").collect()] == ["pb"]
    edges = spark.createDataFrame([("a", "b", "imports", None, 1), ("a", "b", "imports", None, 2), ("a:x", "b", "uses", None, 3)],
                                  "source_id string, target_id string, type string, created_at timestamp, seq int")
    for _ in range(2):
        keyed.save_references(edges, path, buckets=4)
    assert keyed.out_edges(spark, path, "a").count() == 1 and keyed.in_edges(spark, path, "b").count() == 2


def test_a_save_deals_rows_once_by_key_and_once_by_bucket(spark, tmp_path, monkeypatch):
    """One shuffle for the rows that are there and the batch's together, keys not sent twice."""
    t, seen = table(spark, tmp_path, key=("id", "content")), []
    keyed.save(batch(spark, [(f"k{i}", "old") for i in range(50)]), t)
    plain = keyed._touched_only
    monkeypatch.setattr(keyed, "_touched_only", lambda s, rows: (seen.append(rows), plain(s, rows))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keyed.save(batch(spark, [(f"k{i}", "old") for i in range(80)]), t)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text = plan(seen[0])
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    assert content(spark, t) == sorted((f"k{i}", "old") for i in range(80))


def test_the_batch_wins_whatever_the_rows_that_are_there(spark, tmp_path):
    t = table(spark, tmp_path)
    keyed.save(batch(spark, [("a", "1"), ("b", "2"), (None, "3")]).withColumn("seq", F.lit(9)), t)
    keyed.save(batch(spark, [("a", "4"), (None, None), ("a", "5")]), t)
    assert content(spark, t) == sorted([("a", "5"), ("b", "2"), (None, None)], key=repr)


def test_more_input_gets_more_buckets_and_tasks(spark, tmp_path, monkeypatch):
    spark.range(20_000).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert keyed.pieces(rows, 8) == 8
    monkeypatch.setattr(keyed, "BUCKET_BYTES", 5_000)
    n = keyed.pieces(rows, 8)
    assert n > 8
    # a join is no larger than what it reads, and rows of unknown size count as none
    assert keyed.pieces(rows.crossJoin(rows.toDF("b")), 1) <= 2 * n and keyed.pieces(spark.createDataFrame(rows.rdd), 3) == 3
    t, before = table(spark, tmp_path), spark.conf.get("spark.sql.shuffle.partitions")
    with keyed._touched_only(spark, rows):
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == n
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and content(spark, t) == []


def test_saved_edges_are_read_where_they_lie(spark):
    """The batch is evaluated several times: none of them deals out the lines first."""
    from sourceloom.plans import adapters

    seen, save = [], keyed.save
    try:
        keyed.save = lambda b, t, seq="seq": (seen.append(plan(b)), save(b, t, seq))[1]
        tables = adapters.saved_references(spark, "/root/testdata/sf0.001")
    finally:
        keyed.save = save
    assert len(seen) == 4 and not any("Exchange" in x for x in seen) and {t.buckets for t in tables} == {8}
