"""Queries of the corpus operators that SQL can express, against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from meshwork.llm.queries import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries()[name](spark, str(DATA))
    want = con.execute(oracle_sql()[name])
    order = [c[0] for c in want.description]
    assert sorted(order) == sorted(got.columns)
    rows = sorted(map(tuple, got.select(*order).collect()))
    assert rows and rows == sorted(want.fetchall())
