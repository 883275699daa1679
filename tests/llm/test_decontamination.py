import random

import pytest
from pyspark.sql import functions as F

from sourceloom.llm.decontamination import benchmark_hits
from tests.llm import brute
from tests.llm.conftest import prose

ITEMS = [(1, prose(1, 30)), (2, "Only-four plain words"), (3, None), (4, ""), (5, "!!"), (None, prose(2, 20)), (1, prose(50, 12)), (7, "a a a a a a a a a a a a"), (10, prose(1, 30))]


def check(found, rows, items):
    want = sorted([(i, *brute.hits(t, items)) for i, t in rows], key=repr)
    got = []
    for r in found.collect():
        hit = {k for run in r.runs for k in range(run["first"], run["last"] + 1)}
        assert all(b["first"] > a["last"] + 1 for a, b in zip(r.runs, r.runs[1:], strict=False))
        got.append((r.row.doc_id, r.n_words, hit, set(r["items"])))
    assert sorted(got, key=repr) == want


@pytest.mark.parametrize("block", [200_000, 9])
def test_like_brute_force(spark, docs_of, block):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, prose(1, 80)), (4, "x only FOUR  plain words, only four plain"), (5, "a " * 15), (6, "a " * 9), (None, prose(2, 20)), (3, prose(1, 80))]
    vocabulary = prose(1, 30).split()
    for k in range(40):
        at = rng.randint(0, 20)
        rows.append((100 + k, " ".join(rng.choice(vocabulary) for _ in range(20)) + " " + " ".join(vocabulary[at : at + rng.randint(5, 14)])))
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id bigint, text string, words string, width int")
    check(benchmark_hits(docs_of(rows), items, block_windows=block), rows, ITEMS)


def test_odd_rows_and_empty_tables(spark, odd, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check(benchmark_hits(odd, items), rows, ITEMS)
    assert benchmark_hits(odd, items.limit(0)).where(F.size("runs") > 0).count() == 0
    assert benchmark_hits(odd, items.limit(0), carry=odd.columns).select("row.*").columns == odd.columns
    assert benchmark_hits(docs_of([(1, "x")]).limit(0), items).count() == 0


def test_items_without_id(spark, docs_of, tmp_path):
    """The query finds them, as its SQL does: a hit and an item, but none of the listed ids."""
    import duckdb

    from sourceloom.llm.queries import OP1_SQL, op1_decontamination

    rows = [(1, prose(2, 20)), (2, prose(1, 30)), (3, prose(8, 30)), (4, prose(1, 30) + " " + prose(2, 20)), (None, prose(2, 20))]
    docs_of(rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([*ITEMS, (None, prose(1, 30))], "item_id bigint, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in op1_decontamination(spark, str(tmp_path)).collect() if r.doc_id]
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as from '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(got) == sorted(r for r in con.execute(OP1_SQL).fetchall() if r[0])
    assert [r[-1] for r in sorted(got)] == [True, True, False, True]
