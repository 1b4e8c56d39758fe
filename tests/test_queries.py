"""Every named graph query against its SQL at the smallest scale."""

import os

import pytest

from weftgraph.plans import catalog

D = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(D):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return con





@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, D).toPandas()
    want = sql.execute(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(df[columns].itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_entry_points_import():
    import __spark_entry__ as entry

    assert set(catalog.ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
