"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check_sql
from sourceloom import plans

SF = "/root/testdata/sf0.001"
NAMES = sorted(plans.QUERIES)


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for table in check_sql.TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, database, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) > 0 or name == "d1_import_edges"
    sql = entry.oracle_sql().get(name)
    want = database.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check_sql.rows(got) == check_sql.rows(want)


def test_every_operator_has_a_query():
    counts = {"a": 9, "b": 9, "c": 9, "d": 7, "e": 7, "f": 2, "g": 1, "h": 10, "i": 4, "j": 12}
    covered = {n.split("_")[0] for n in NAMES}
    assert covered == {f"{k}{i}" for k, n in counts.items() for i in range(1, n + 1)}


def test_entry(spark):
    assert entry.entry(spark).count() == 210
