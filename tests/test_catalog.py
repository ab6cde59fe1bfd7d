"""Every registered query of the core library runs; those with SQL agree with DuckDB."""

import glob
import os

import duckdb
import pytest

from matchlight.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return round(float(v), 5) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    x = catalog.queries()[name](spark, SF)
    assert x.count() > 0
    if name.endswith(("metric", "fit", "repair", "sums")):
        m = {(r["i"], r["j"]): r["v"] for r in x.collect()}
        assert all(abs(m[i, j] - m[j, i]) < 1e-5 for i, j in m)


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "retrieval_map" in e.queries()
