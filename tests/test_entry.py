"""Driver contract: entry() on sf0.001, every registered query against its SQL by value."""
import os

import pytest

import __spark_entry__ as E
from pingpath.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["code", "cluster_id", "lat", "lon", "report_count", "session_count", "last_ts",
                          "stop_rank", "stop_name", "distance_m", "eta_minutes"]
    assert df.count() >= 0


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(E.queries()) and set(catalog.ORACLE) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    mine = sorted(tuple(str(r[c]) for c in cols) for r in got.collect())
    order = [want.columns.index(c) for c in cols]
    assert mine == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())
