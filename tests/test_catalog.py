"""Each registered query of the reference's operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tidelog import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "documents"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = catalog.queries()[name](spark, SF)
    want = con.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(str, (tuple(r) for r in got.select(columns).collect())))
    plain = con.sql(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert rows == sorted(map(str, plain))
